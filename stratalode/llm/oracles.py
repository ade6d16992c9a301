"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
 iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from benchmark),
 cut as (select item_id, ws, least(10, len(ws)) as n from iw where len(ws) > 0),
 win as (select item_id, n, array_to_string(ws[i:i + n - 1], ' ') as k from (select *, unnest(range(1, len(ws) - n + 2)) as i from cut)),
 ks as (select distinct k, n from win),
 pos as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as k from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from dw, (select distinct n from ks))),
 hit as (select doc_id, i, n, k from pos join ks using (k, n)),
 covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
 found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item_id::varchar as item from hit join win using (k, n)) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join found using (doc_id)"""

REPEATS = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') as ws from documents),
 win as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k from (select *, unnest(range(1, len(ws) - 48)) as i from w)),
 first as (select k, min(doc_id) as d from win group by 1),
 gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win join first using (k) where d < doc_id)),
 every as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
 kept as (select doc_id, string_agg(word, ' ' order by p) as s, count(*) as n from every anti join gone using (doc_id, p) group by 1)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from w left join kept using (doc_id)"""

URL_FILTERS = f"""
with cut as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, translate(url, '{UPPER}', '{LOWER}') as low from pages),
 ruled as (select *, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
   when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
   when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
   when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from cut),
 fits as (select *, case when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?example[.]org/(?s:.*)/about([^a-z0-9_.%-]|$)') then '||example.org/*/about^'
   when regexp_matches(low, '([^a-z0-9_.%-])affiliate[^a-z0-9_.%-].*([^a-z0-9_.%-])click([^a-z0-9_.%-]|$)') then '^affiliate^*^click^'
   when regexp_matches(low, '[^a-z0-9_.%-]doubleclick([^a-z0-9_.%-]|$)') then '^doubleclick^'
   when contains(low, '/wp-login.php') then '/wp-login.php'
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?cheap-pills[.]') then '||cheap-pills.'
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?ads-track.*[.]') then '||ads-track*.'
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?spam-farm[.]') then '||spam-farm.'
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?free-bets[.]') then '||free-bets.'
   when regexp_matches(low, '[^a-z0-9_.%-]sessionid=') then '^sessionid='
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?adult-.*[.]') then '||adult-*.'
   when regexp_matches(low, '^[^/?#]*?://([^/?#]*[.])?casino-') then '||casino-'
   when contains(low, 'viagra') then '*viagra*'
   when regexp_matches(low, '-casino([^a-z0-9_.%-]|$)') then '-casino^'
   when regexp_matches(low, '[^a-z0-9_.%-]gclid=') then '^gclid='
   when starts_with(low, 'ftp://') then '|ftp://'
   when ends_with(low, '.apk') then '.apk|'
   when ends_with(low, '.exe') then '.exe|' end as p from ruled)
select page_id, host, path, rule, case when rule is null then p end as pattern,
 case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when p is null or p = '||example.org/*/about^' then 'allow' else 'block' end as verdict from fits"""

DIVERGENCE = f"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row from documents),
 w as (select lang, source, row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
 kept as (select lang, term from w group by 1, 2 having count(distinct row) >= 10),
 v as (select lang, count(*) as v from kept group by 1),
 g as (select distinct lang, source from d),
 n as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by 1, 2, 3),
 each as (select lang, source, term, coalesce(n, 0) as n from g join kept using (lang) left join n using (lang, source, term)),
 p as (select lang, source, term, n, 1 + (1000000000 * (n + 2)::hugeint) // (sum(n) over (partition by lang, source) + 2 * v) as p from each join v using (lang)),
 l as (select lang, term, sum(n) as n from n group by 1, 2),
 q as (select lang, term, 1 + (1000000000 * (n + 2)::hugeint) // (sum(n) over (partition by lang) + 2 * v) as q from l join v using (lang)),
 pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by 1, 2, 3),
 terms as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
 every as (select lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b using (lang) left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source where a.source <> b.source
   union all select lang, source, 'term', item, value::bigint from terms),
 ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
select * from ranked where part = 'pair' or rank <= 10"""
