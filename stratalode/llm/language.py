"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language comes from a naive Bayes model over letter trigrams. It is
combined with the language a page declares, and with a prior for its host. Host priors are smoothed
along a hierarchy: all rows, address suffix, host; each level's counts are soft counts from the texts,
summed by grouped aggregation, and a row's own share is taken out of its host's counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_small_batches, stored, table

BUCKETS = 1 << 15
#: Trigrams that count at most: beyond it a longer text is no surer, since trigrams are not independent.
SURE = 40.0
STRENGTH = 20.0
ALPHA = 0.5
WORDS = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000


def trigrams(word: str) -> list[int]:
    import zlib

    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


class Model:
    """Log-likelihoods of trigrams under each language, from (language, bucket, count)."""

    def __init__(self, seen: list[tuple[str, int, int]], langs: list[str]):
        self.langs = sorted(langs)
        counts = np.full((BUCKETS, len(self.langs)), ALPHA)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, bucket, n in seen:
            counts[bucket, at[lang]] += n
        self.log = np.log(counts / counts.sum(0))


def _count(batches):
    """Trigrams of labelled texts by language and bucket."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            at = [g for w in WORDS.findall(text.lower()) for g in trigrams(w)]
            sums[lang] = sums.get(lang, 0) + np.bincount(at, minlength=BUCKETS)
    rows = [(lang, int(i), int(c[i])) for lang, c in sums.items() for i in np.flatnonzero(c)]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "bucket", "n"])


def fit(docs: DataFrame, rows: int = 1000) -> Model:
    """A model from labelled texts (text, lang): `rows` in all at most, or one for each language if these are more.

    Every language gets an equal share of them, its distinct texts with the smallest hashes, so neither copies nor a frequent
    language can fill the sample. Only hashes are ranked; the driver gets counts by language and bucket.
    """
    docs = docs.where("text is not null and lang is not null").select("text", "lang")
    seen = stored(docs.select("lang", F.xxhash64("text").alias("h")).distinct(), "labelled")
    langs = [r.lang for r in seen.select("lang").distinct().collect()]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = seen.withColumn("rank", rank).where(F.col("rank") <= max(1, rows // max(1, len(langs)))).select(F.col("lang").alias("l"), "h")
    texts = docs.join(F.broadcast(some), (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["lang", "h"])
    counts = in_small_batches(texts).select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()], langs)


def _score(model: Model, names: list[str]):
    def run(batches):
        known: dict[str, int] = {}
        sums = np.zeros((1024, len(model.langs) + 1))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out = np.zeros((b.num_rows, len(model.langs) + 1))
                for i, t in enumerate(b.column("text").to_pylist()):
                    rows = []
                    for w in WORDS.findall((t or "").lower()):
                        k = known.get(w)
                        if k is None:
                            if len(known) >= REMEMBERED:
                                if rows:
                                    out[i] += sums[rows].sum(0)
                                    rows = []
                                known.clear()
                            k = known[w] = len(known)
                            if k >= len(sums):
                                sums = np.concatenate((sums, np.zeros_like(sums)))
                            g = trigrams(w)
                            sums[k] = [*model.log[g].sum(0), len(g)]
                        rows.append(k)
                    if rows:
                        out[i] += sums[rows].sum(0)
                n = out[:, -1:]
                logit = out[:, :-1] * np.minimum(1.0, SURE / np.maximum(n, 1))
                logit = np.where(n > 0, logit - logit.max(1, keepdims=True), 0.0)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(logit.ravel()), len(model.langs)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n.ravel().astype(np.int64)), lists], [*names, "n_trigrams", "logit"])

    return run


def softmax(logit: Column) -> Column:
    top = F.array_max(logit)
    e = F.transform(logit, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """key, lang, confidence, n_trigrams for every row of key, text, declared, host, suffix (strings, each may be null).

    One row for each row. lang is null (and the row should be refused) if the text is null, has no letters, or no language
    reaches half of the posterior. Equal posteriors (ties) go to the first language by name. Keys may be null or repeated, and
    repeated rows give repeated results; null hosts and suffixes each form a group, with the empty ones. Long texts count whole,
    but no text's likelihood counts for more than SURE trigrams. No rows: no rows. Other columns are ignored.
    """
    langs = model.langs
    names = [key, "declared", "host", "suffix"]
    rows = rows.select(key, *[F.coalesce(F.lower(c), F.lit("")).alias(c) for c in names[1:]], "text")
    kind = dict(rows.dtypes)[key]
    seen = stored(in_small_batches(rows).mapInArrow(_score(model, names), f"{key} {kind}, declared string, host string, suffix string, n_trigrams long, logit array<double>"), "evidence")
    if not langs:
        return seen.select(key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "n_trigrams")
    seen = seen.withColumn("own", F.when(F.col("n_trigrams") > 0, softmax(F.col("logit"))).otherwise(F.array(*[F.lit(0.0)] * len(langs))))

    def sums(*by: str, to: str) -> DataFrame:
        """Soft counts by a key; partial sums leave the map side, so a frequent key is no hot spot."""
        got = seen.groupBy(*by).agg(*[F.sum(F.get("own", F.lit(i))).alias(f"_{i}") for i in range(len(langs))])
        return got.select(*by, F.array(*[f"_{i}" for i in range(len(langs))]).alias(to))

    hosts = sums("suffix", "host", to="h")
    total = hosts.agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(len(langs))])).first()[0]
    total = [x or 0.0 for x in total]
    root = F.array(*[F.lit((x + 1.0) / (sum(total) + len(langs))) for x in total])
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mix = lambda counts, prior: F.zip_with(counts, prior, lambda c, p: (c + STRENGTH * p) / (add(counts) + STRENGTH))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(len(langs))]).alias("s")).select("suffix", mix(F.col("s"), root).alias("up"))
    priors = stored(hosts.join(suffixes, "suffix"), "priors")
    declared = sums("declared", to="d").where(F.col("declared").isin(langs)).collect()  # as many rows as languages
    said = {r.declared: r.d for r in declared}
    all_said = [sum(r.d[i] for r in declared) for i in range(len(langs))]
    fits = F.lit(None).cast("array<double>")
    for lang, d in said.items():
        fits = F.when(F.col("declared") == lang, F.array(*[F.lit(float(np.log((x + 1) / (a + len(langs))))) for x, a in zip(d, all_said, strict=True)])).otherwise(fits)
    df = seen.join(priors, ["suffix", "host"], "left")
    left = F.zip_with("h", "own", lambda h, o: F.greatest(h - o, F.lit(0.0)))
    prior = mix(left, F.col("up"))
    both = F.zip_with(F.zip_with("logit", prior, lambda x, p: x + F.log(p)), F.coalesce(fits, F.array(*[F.lit(0.0)] * len(langs))), lambda x, y: x + y)
    df = df.select(key, "n_trigrams", softmax(both).alias("post"))
    top = F.array_max("post")
    name = F.element_at(F.array(*map(F.lit, langs)), F.array_position("post", top).cast("int"))
    return df.select(key, F.when((F.col("n_trigrams") > 0) & (top >= 0.5), name).alias("lang"), top.alias("confidence"), "n_trigrams")


MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"
#: What opens and what closes a stretch, and what the opener becomes where nothing closes it any more.
STRETCHES = [("<!--", "-->", "<! --"), (r"(?i)<(?=script\b)", "</script>", "< "), (r"(?i)<(?=style\b)", "</style>", "< "), ("<", ">", " ")]


def visible(pages: DataFrame, html: str) -> DataFrame:
    """pages with column `html` without its markup, scripts and styles, in time proportional to its length.

    MARKUP would run to the end of the page from every opener that nothing closes. So openers after the last closer of their kind are
    made plain first; what they would match then is what they match now, a tag or nothing.
    """
    for opener, closer, plain in STRETCHES:
        pages = pages.withColumn("__head", F.regexp_extract(html, f"(?is)^(.*{closer})", 1))
        tail = F.substring(html, F.length("__head") + 1, F.length(html))
        pages = pages.withColumn(html, F.concat("__head", F.regexp_replace(tail, opener, plain))).drop("__head")
    return pages.withColumn(html, F.regexp_replace(html, MARKUP, " "))


def from_pages(pages: DataFrame) -> DataFrame:
    """page_id, text (markup, scripts and styles taken out), declared language, host and address suffix.

    A null html is a null text that declares nothing; a null or unreadable url has an empty host and suffix. A very long or broken page takes
    time in proportion to its length.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^<>]*\blang=[\"']?([a-zA-Z]{2})", 1))
    pages = pages.select("page_id", F.col("html").alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))
    return visible(pages, "text")


def op7_language_id(spark, sf_dir):
    """The language of every page, from a model fitted on labelled documents."""
    return identify(from_pages(table(spark, sf_dir, "pages")), fit(table(spark, sf_dir, "documents")), "page_id")


def stage(spark, docs, sf_dir):
    """Drops the documents whose language can't be told. `lang` is what they declare, `source` their host.

    Null and letterless texts go; every other row stays with all its columns, whatever its doc_id, and so do repeated rows.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("key"), "lang", "source")  # ids may be null or repeated
    rows = docs.select(row.alias("row"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    got = identify(rows, fit(docs), "row")
    bad = stored(got.where("lang is null").select(*[F.col(f"row.{c}").alias(f"__{c}") for c in ("doc_id", "key", "lang", "source")]).distinct(), "refused")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "lang", "source")]
    return docs.join(bad, (F.xxhash64("text") == F.col("__key")) & same[0] & same[1] & same[2], "left_anti")
