"""Quality by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target texts and one of all
texts, give each text its log importance weight, the log ratio of its likelihoods. Adding Gumbel
noise and keeping the k largest keys draws k texts without replacement in proportion to weight.
The k-th key is found exactly by counting in ever narrower intervals, without a sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .repeats import Known

BUCKETS = 1 << 14
SMOOTH = 1.0
REMEMBERED = 300_000


def _hasher():
    """Buckets of a text's n-grams: words in lower case, then pairs of neighbours."""
    known = Known()

    def grams(text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(known) > REMEMBERED:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (np.concatenate((h, pairs)) >> np.uint64(50)).astype(np.int64)  # 14 bits

    return grams


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def _count(batches):
    grams, sums = _hasher(), np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for t, good in zip(_texts(b), b.column("target").to_pylist(), strict=True):
            c = np.bincount(grams(t), minlength=BUCKETS)
            sums[0] += c
            if good:
                sums[1] += c
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])


def _weigh(ratio: np.ndarray):
    def run(batches):
        grams = _hasher()
        for b in batches:
            got = [grams(t) for t in _texts(b)]
            cols = [b.column("doc_id"), b.column("text_key"), pa.array([len(g) for g in got], pa.int64()), pa.array([float(ratio[g].sum()) for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_grams", "log_weight"])

    return run


def log_ratio(docs: DataFrame, good: DataFrame, most_targets: int = 20_000) -> np.ndarray:
    """Log of target over raw probability for each bucket. The driver gets one row a bucket, a fixed number.

    All texts make the raw model. The target model takes at most most_targets labelled texts, those
    whose ids have the smallest hashes; that bound is what allows their ids to be broadcast.
    """
    mark = good.select(F.col("doc_id").cast("long").alias("g")).where("g is not null").distinct().orderBy(F.xxhash64("g"), "g").limit(most_targets)
    both = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(mark), F.col("doc_id") == F.col("g"), "left").select("text", F.col("g").isNotNull().alias("target"))
    rows = both.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash), n_grams, log_weight for every row. Texts without words weigh 0."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_weigh(log_ratio(docs, good)), "doc_id long, text_key long, n_grams long, log_weight double")


def gumbel(seed: int):
    """Gumbel noise fixed by doc_id, text and seed, so that a task run again draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text_key"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value, exactly: the interval that holds it is cut into 1000 parts until few values are left in it."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / 1000
        if width <= 0 or low + width == low:
            break
        inside = rows.where(F.col(key).between(low, high))
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(999))
        above, found = 0, None
        for r in sorted(inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("a"), F.max(key).alias("b")).collect(), key=lambda r: -r.p):
            if above + r.c >= k:
                found = r
                break
            above += r.c
        k, low, high = k - above, found.a, found.b
        if found.c <= 10_000:
            return sorted((x[0] for x in rows.where(F.col(key).between(low, high)).select(key).collect()), reverse=True)[k - 1]
    return low


def resample(docs: DataFrame, good: DataFrame, share: float = 0.5, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, selected for every row: k rows drawn without replacement, k the share rounded down.

    log_weight is the log ratio of the text's likelihoods under the two models, a sum over all its n-grams however long it is.
    Null and wordless texts weigh 0. Noise depends on doc_id and text, so equal rows tie; of rows tied at the k-th key as
    many as are wanted are selected, by a number drawn from their places. doc_ids may be null or repeated. Without target texts
    the two models are a flat one and the corpus. No rows, or no share: none selected. Other columns are ignored.
    """
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 2)
    rows = weights(docs, good).withColumn("sample_key", F.col("log_weight") + gumbel(seed)).withColumn("tie", tie)
    rows = stored(rows.drop("text_key"), "weights")
    k = int(rows.count() * share)
    cut = kth_largest(rows, "sample_key", k)
    if cut is None:
        return rows.withColumn("selected", F.lit(False)).drop("tie")
    level = rows.where(F.col("sample_key") == cut)
    left = k - rows.where(F.col("sample_key") > cut).count()
    last = kth_largest(level, "tie", left) if left < level.count() else None
    wins = F.lit(True) if last is None else F.col("tie") >= last
    return rows.withColumn("selected", (F.col("sample_key") > cut) | ((F.col("sample_key") == cut) & wins)).drop("tie")


def op8_importance_resampling(spark, sf_dir):
    """Target: labelled documents of good quality that aren't toxic. As large a share is selected as is good among the labelled."""
    labels = table(spark, sf_dir, "labels")
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    share = labels.agg(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))).first()[0]
    return resample(table(spark, sf_dir, "documents"), good, share or 0.0)
