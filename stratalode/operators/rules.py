"""The 63 built-in rules."""

from __future__ import annotations

# Id, severity, languages, pattern, what it matches, CWE, OWASP category.
RULES = [
    ('SEC-001', 'HIGH', ('javascript', 'html'), '\\.innerHTML\\s*=\\s*`[^`]*\\$\\{(?![^`]*(escHtml|escapeHtml|sanitize|DOMPurify|textContent))', 'template literal with ${} into innerHTML, no sanitizer', 'CWE-79', 'A03:2021-Injection'),
    ('SEC-002', 'HIGH', ('javascript', 'html'), '\\.innerHTML\\s*=\\s*[\'\\"][^\'\\"]*[\'\\"]\\s*\\+\\s*\\w+', 'string + variable into innerHTML', 'CWE-79', 'A03:2021-Injection'),
    ('SEC-003', 'HIGH', ('python',), '(subprocess\\.(run|call|Popen|check_output)\\([^)]*\\b(shell\\s*=\\s*True))', 'subprocess with shell=True', 'CWE-78', 'A03:2021-Injection'),
    ('SEC-004', 'HIGH', ('python',), '(execute|executemany)\\(\\s*(f[\'\\"][^\'\\"]*\\{[^}]*\\}|[\'\\"][^\'\\"]*%s)', 'f-string / %s inside execute()', 'CWE-89', 'A03:2021-Injection'),
    ('SEC-005', 'MEDIUM', ('python',), 'urlopen\\(.*\\+|urlopen\\(f[\'\\"]|requests\\.(get|post|put|delete)\\(.*\\+', 'concatenated / f-string URL in urlopen or requests', 'CWE-918', 'A10:2021-SSRF'),
    ('SEC-006', 'MEDIUM', ('python',), 'Access-Control-Allow-Origin[\'\\"],?\\s*[\'\\"]?\\*', 'wildcard CORS origin', 'CWE-942', 'A05:2021-Security Misconfiguration'),
    ('SEC-007', 'HIGH', ('python', 'javascript'), '\\b(eval|exec)\\s*\\(', 'eval( / exec(', 'CWE-94', 'A03:2021-Injection'),
    ('SEC-008', 'MEDIUM', ('python',), '(password|secret|token|api_key)\\s*=\\s*[\'\\"][^\'\\"]+[\'\\"]', 'credential literal assigned', 'CWE-798', 'A07:2021-Identification and Authentication Failures'),
    ('SEC-009', 'HIGH', ('python',), 'pickle\\.loads?\\(|yaml\\.load\\([^)]*(?!Loader\\s*=\\s*yaml\\.SafeLoader)', 'pickle.load(s) / unsafe yaml.load', 'CWE-502', 'A08:2021-Software and Data Integrity Failures'),
    ('SEC-010', 'MEDIUM', ('python',), '(os\\.path\\.join\\([^\\n]*(\\.\\.|path|file|name|input|request)|open\\([^\\n]*(\\.\\.|path|file|name|input|request))', 'path join/open on input-like names', 'CWE-22', 'A01:2021-Broken Access Control'),
    ('SEC-011', 'MEDIUM', ('python',), '(password|secret|token|api_key|hash|digest)\\s*==\\s*', 'secret compared with ==', 'CWE-208', 'A02:2021-Cryptographic Failures'),
    ('SEC-012', 'HIGH', ('python',), '(DEBUG\\s*=\\s*True|debug\\s*=\\s*True|app\\.debug\\s*=\\s*True)', 'debug flag set True', 'CWE-489', 'A05:2021-Security Misconfiguration'),
    ('SEC-013', 'MEDIUM', ('python',), 'hashlib\\.(md5|sha1)\\(', 'md5/sha1 call', 'CWE-328', 'A02:2021-Cryptographic Failures'),
    ('SEC-014', 'HIGH', ('python',), 'verify\\s*=\\s*False', 'verify=False', 'CWE-295', 'A02:2021-Cryptographic Failures'),
    ('QUAL-001', 'MEDIUM', ('python',), 'except\\s*:', 'bare except', 'CWE-396', ''),
    ('QUAL-002', 'LOW', ('python',), 'except\\s+\\w+(\\s*,\\s*\\w+)*\\s*:\\s*$', 'except X: ending its line', 'CWE-391', ''),
    ('QUAL-003', 'MEDIUM', ('python',), 'int\\(\\s*(request|qs|params|args|query|self\\.path|environ)\\b[^)]*\\)', 'int() over request-like value', 'CWE-20', 'A03:2021-Injection'),
    ('QUAL-004', 'MEDIUM', ('python',), 'float\\(\\s*(request|qs|params|args|query|self\\.path|environ)\\b[^)]*\\)', 'float() over request-like value', 'CWE-20', 'A03:2021-Injection'),
    ('QUAL-005', 'LOW', ('python',), '\\.items\\(\\)\\s*$(?!\\s*(if|for|return))', '.items() at line end', 'CWE-476', ''),
    ('QUAL-006', 'MEDIUM', ('python',), 'threading\\.Thread\\(.*daemon\\s*=\\s*False', 'daemon=False thread', 'CWE-404', ''),
    ('QUAL-007', 'LOW', ('python', 'javascript'), '(TODO|FIXME|HACK|XXX|TEMP)\\b', 'debt marker words', 'CWE-546', ''),
    ('QUAL-008', 'MEDIUM', ('python',), 'time\\.sleep\\(\\s*\\d{2,}\\s*\\)', 'sleep with 2+ digit seconds', 'CWE-400', ''),
    ('QUAL-009', 'HIGH', ('python',), 'send_header\\([\'\\"]Connection[\'\\"]\\s*,\\s*[\'\\"]keep-alive[\'\\"]', 'explicit keep-alive header', 'CWE-404', ''),
    ('QUAL-010', 'MEDIUM', ('javascript', 'html'), 'localStorage\\.(setItem|getItem)\\([^)]+\\)(?![^;]*(try|catch))', 'localStorage without try/catch', 'CWE-922', 'A04:2021-Insecure Design'),
    ('QUAL-011', 'MEDIUM', ('python',), 'except\\s+Exception\\s*:', 'except Exception', 'CWE-396', ''),
    ('QUAL-012', 'LOW', ('python',), 'for\\s+\\w+\\s+in\\s+.*:\\s*\\n\\s+\\w+\\s*\\+=\\s*[\'\\\\\\"]|for\\s+\\w+\\s+in\\s+.*:\\s*\\n\\s+\\w+\\s*=\\s*\\w+\\s*\\+\\s*[\'\\\\\\"]', 'string += inside for (2-line match)', 'CWE-1050', ''),
    ('QUAL-013', 'LOW', ('python', 'javascript'), '^.{200,}$', 'line of 200+ chars', 'CWE-1120', ''),
    ('PY-001', 'MEDIUM', ('python',), 'def\\s+\\w+\\([^)]*\\)\\s*->\\s*None:', 'def annotated -> None', 'CWE-394', ''),
    ('PY-002', 'HIGH', ('python',), 'self\\.\\w+\\([^)]*\\)\\.items\\(\\)', 'self.m().items()', 'CWE-476', ''),
    ('PY-003', 'MEDIUM', ('python',), 'import\\s+\\*|from\\s+\\w+\\s+import\\s+\\*', 'star import', 'CWE-1108', ''),
    ('PY-004', 'LOW', ('python',), 'print\\s*\\(', 'print call', 'CWE-497', ''),
    ('PY-005', 'HIGH', ('python',), '(json\\.loads|json\\.load)\\([^)]+\\)(?!\\s*#\\s*nosec)(?![^#]*(try|except))', 'json.load(s) unguarded', 'CWE-755', ''),
    ('PY-006', 'MEDIUM', ('python',), 'global\\s+\\w+', 'global statement', 'CWE-1108', ''),
    ('PY-007', 'MEDIUM', ('python',), 'os\\.environ\\[', 'os.environ[...]', 'CWE-394', ''),
    ('PY-008', 'MEDIUM', ('python',), '\\bopen\\((?![^)]*(?:encoding|[\'\\"]r?b[\'\\"]))[^)]+\\)', 'open() with no encoding', 'CWE-838', ''),
    ('PY-009', 'MEDIUM', ('python',), 'except\\s+\\w+\\s+as\\s+\\w+\\s*:\\s*\\n\\s*(pass|\\.\\.\\.)\\s*$', 'except-as then pass (2-line match)', 'CWE-391', ''),
    ('PY-010', 'MEDIUM', ('python',), 'sys\\.exit\\(\\d+\\)', 'sys.exit(n)', 'CWE-382', ''),
    ('PY-011', 'LOW', ('python',), 'isinstance\\([^,]+,\\s*\\([^)]{80,}\\)\\)', 'isinstance with 80+ char tuple', 'CWE-1120', ''),
    ('PORT-001', 'HIGH', ('python',), '(?:Path|path|=\\s*r?[\'"]).{0,5}C:[/\\\\]Users[/\\\\]\\w+', 'C:/Users/<name> path', 'CWE-1059', ''),
    ('PORT-002', 'HIGH', ('python',), '(?:Path|path|=\\s*r?[\'"]).{0,5}C:[/\\\\]AI[/\\\\]', 'C:/AI path', 'CWE-1059', ''),
    ('PORT-003', 'MEDIUM', ('python',), '(?:Path|os\\.chdir|open)\\s*\\(\\s*r?[\'"](?:[A-Z]:[/\\\\](?!Users[/\\\\]|AI[/\\\\]|Windows[/\\\\]|Program))[^\'"]{5,}[\'"]', 'other absolute drive path', 'CWE-1059', ''),
    ('PORT-004', 'MEDIUM', ('python',), '(?:import\\s+winreg|import\\s+msvcrt|from\\s+ctypes\\.wintypes\\s+import)', 'Windows-only import', 'CWE-1059', ''),
    ('JS-SEC-001', 'HIGH', ('javascript', 'html'), '\\.innerHTML\\s*=\\s*(?!.*(?:escHtml|escapeHtml|sanitize|DOMPurify|textContent))', 'any unsanitized innerHTML =', 'CWE-79', 'A03:2021-Injection'),
    ('JS-SEC-002', 'HIGH', ('javascript', 'html'), 'document\\.write\\s*\\(', 'document.write(', 'CWE-79', 'A03:2021-Injection'),
    ('JS-SEC-003', 'HIGH', ('javascript', 'html'), '\\beval\\s*\\(', 'eval(', 'CWE-95', 'A03:2021-Injection'),
    ('JS-SEC-004', 'HIGH', ('javascript', 'html'), '(?:localStorage|sessionStorage)\\s*\\.\\s*setItem\\s*\\(\\s*[\'\\"](?:token|secret|password|api[_-]?key|auth|jwt|session)', 'secret key in web storage', 'CWE-922', 'A02:2021-Cryptographic-Failures'),
    ('JS-SEC-005', 'MEDIUM', ('javascript',), '(?:window\\.)?postMessage\\s*\\([^)]*,[^)]*[\'\\"\\s]*\\*[\'\\"\\s]*\\)', 'postMessage to *', 'CWE-346', 'A01:2021-Broken-Access-Control'),
    ('JS-SEC-006', 'HIGH', ('javascript',), 'new\\s+Function\\s*\\(', 'new Function(', 'CWE-95', 'A03:2021-Injection'),
    ('JS-SEC-007', 'MEDIUM', ('javascript', 'html'), '<form\\b[^>]*(?!.*csrf|.*_token|.*xsrf)[^>]*>', 'form tag w/o csrf', 'CWE-352', 'A01:2021-Broken-Access-Control'),
    ('JS-SEC-008', 'HIGH', ('javascript',), '\\b(?:Object\\.assign|_\\.merge|_\\.extend|_\\.defaultsDeep)\\s*\\(\\s*(?:req\\.body|req\\.query|req\\.params|user[Ii]nput|data)', 'merge of untrusted object', 'CWE-1321', 'A03:2021-Injection'),
    ('JS-REACT-001', 'MEDIUM', ('javascript',), 'dangerouslySetInnerHTML\\s*=\\s*\\{', 'dangerouslySetInnerHTML', 'CWE-79', 'A03:2021-Injection'),
    ('JS-REACT-002', 'MEDIUM', ('javascript',), 'useEffect\\s*\\(\\s*(?:async\\s+)?\\(\\s*\\)\\s*=>\\s*\\{[^}]*(?:fetch|axios|api\\(|\\.get\\(|\\.post\\()[^}]*\\}\\s*,\\s*\\[\\s*\\]\\s*\\)', 'useEffect fetch, empty deps', 'CWE-404', ''),
    ('JS-REACT-003', 'LOW', ('javascript',), 'useState\\s*\\(\\s*\\[\\s*\\]\\s*\\)|useState\\s*\\(\\s*\\{\\s*\\}\\s*\\)', 'useState with fresh [] / {}', '', ''),
    ('JS-REACT-004', 'MEDIUM', ('javascript',), '(?:setState|dispatch)\\s*\\(\\s*(?:.*\\bstate\\b)', 'setState/dispatch mentioning state', 'CWE-362', ''),
    ('JS-QUAL-001', 'MEDIUM', ('javascript',), '\\.catch\\s*\\(\\s*\\(\\s*\\)\\s*=>\\s*\\{\\s*\\}\\s*\\)', 'empty catch arrow', 'CWE-390', ''),
    ('JS-QUAL-002', 'MEDIUM', ('javascript',), '(?:async\\s+function|\\basync\\s*\\([^)]*\\)\\s*=>)\\s*\\{(?:(?!try\\s*\\{|\\.catch\\s*\\()[\\s\\S])*(?:await\\s+)', 'await without try/catch (multi-line)', 'CWE-755', ''),
    ('JS-QUAL-003', 'LOW', ('javascript',), 'console\\.\\s*(?:log|warn|error|debug|info|trace)\\s*\\(', 'console.*', 'CWE-497', ''),
    ('JS-QUAL-004', 'MEDIUM', ('javascript',), '(?:==\\s*null|!=\\s*null|==\\s*undefined|!=\\s*undefined)(?!\\s*=)', 'loose null/undefined equality', 'CWE-480', ''),
    ('JS-QUAL-005', 'MEDIUM', ('javascript',), '(?:var\\s+\\w+)', 'var declaration', '', ''),
    ('JS-QUAL-006', 'LOW', ('javascript',), '(?://|/\\*)\\s*(?:TODO|FIXME|HACK|XXX)\\b', 'debt marker in JS comment', 'CWE-546', ''),
    ('JS-QUAL-007', 'MEDIUM', ('javascript',), '(?:setTimeout|setInterval)\\s*\\([^,)]+,\\s*0\\s*\\)', 'zero-delay timer', '', ''),
    ('JS-QUAL-008', 'HIGH', ('javascript',), '(?:catch\\s*\\(\\s*\\w+\\s*\\)\\s*\\{[^}]*(?:throw\\s+\\w+|throw\\s+new\\s+Error).*\\})', 'rethrow inside catch', 'CWE-755', ''),
    ('JS-DEAD-001', 'LOW', ('javascript',), '^import\\s+\\{[^}]+\\}\\s+from\\s+[\'\\"](?:react|react-dom)[\'\\"];?\\s*$', 'named react import line', '', ''),
]

#: Rules whose matches inside strings or comments don't count (Python files), and those for which only strings don't.
NOT_IN_STRINGS_OR_COMMENTS = ("PY-004", "PY-006", "PY-007", "SEC-007", "QUAL-010")
NOT_IN_STRINGS = ("QUAL-007",)

#: Rules that policies drop on test paths.
DROPPED_BALANCED = ("SEC-003", "SEC-007", "SEC-009", "SEC-012", "SEC-014")
DROPPED_RELAXED = (*DROPPED_BALANCED, "SEC-004", "SEC-005", "SEC-010", "PY-007", "PY-008")

BY_ID = {r[0]: r for r in RULES}
