"""A quality classifier by importance resampling (operator 10).

Two generative models of hashed n-grams, one of labelled good text and one of all raw text, give each document
the log of its importance weight; documents are sampled without replacement by Gumbel top-k on it. n-grams are
words, pairs of words, and triples of word shapes, where a shape also tells whether the word repeats the one before.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import words
from .common import Scratch, mapped, mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FAMILIES = 3
#: Bound on the labelled documents of each class that fit the target model and the threshold.
MOST_LABELLED = 20_000
#: Added to each bucket's count in the target and to the count expected of it, so that rare n-grams weigh little.
SMOOTHING = 10.0
#: Factor of the Gumbel noise; 1 samples by weight, small values take the best, large ones sample evenly.
TEMPERATURE = 1.0
#: n-grams of the text that a scaled weight stands for; more bring the sample nearer to the best k.
LENGTH = 100
#: Words whose shapes a task remembers.
MOST_SHAPES = 200_000

_SHAPE = [(re.compile(p), r) for p, r in ((r"[0-9]+", "0"), (r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (r"(\W)\1+", r"\1\1"))]
_SHIFT = np.uint64(64 - BUCKET_BITS)


def shape(word: bytes) -> str:
    text = word.decode(errors="replace")
    for pattern, to in _SHAPE:
        text = pattern.sub(to, text)
    return text[:16]


class _Ngrams:
    """Bucket numbers of the n-grams of a run of texts, with the text that each is of, family by family."""

    def __init__(self):
        import xxhash

        self.of, self.known = xxhash.xxh3_64_intdigest, {}

    def shapes(self, data: bytes, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of each word's shape; those of so many words are remembered."""
        own, at, back = np.unique(h, return_index=True, return_inverse=True)
        known, out = self.known, np.empty(len(own), np.uint64)
        if len(known) > MOST_SHAPES:
            known.clear()
        for k, (word, a, b) in enumerate(zip(own.tolist(), first[at].tolist(), last[at].tolist(), strict=True)):
            s = known.get(word)
            if s is None:
                s = known[word] = self.of(shape(data[a:b]))
            out[k] = s
        return out[back]

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        data = b"\n".join(texts)
        h, first, last = words.split(data)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
        together = owner[1:] == owner[:-1]
        again = np.zeros(len(h), np.uint64)
        again[1:] = together & (h[1:] == h[:-1])
        s = mix(self.shapes(data, h, first, last) + again)
        before, behind = s.copy(), s.copy()
        before[1:][together], behind[:-1][together] = s[:-1][together], s[1:][together]
        pairs = mix(h[:-1] ^ mix(h[1:]))[together]
        triples = mix(before + mix(s + mix(behind)))
        families = ((h, owner), (pairs, owner[:-1][together]), (triples, owner))
        return [((mix(x) >> _SHIFT).astype(np.int64) + k * BUCKETS, of) for k, (x, of) in enumerate(families)]


class _Count:
    def __init__(self, good: frozenset):
        self.good, self.ngrams = good, _Ngrams()
        self.raw, self.target = (np.zeros(FAMILIES * BUCKETS, np.int64) for _ in range(2))

    def __call__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_pylist()
        for at, texts in words.parts(batch.column("text")):
            good = np.array([i in self.good for i in ids[at : at + len(texts)]], bool)
            for buckets, owner in self.ngrams(texts):
                self.raw += np.bincount(buckets, minlength=len(self.raw))
                if good.any():
                    self.target += np.bincount(buckets[good[owner]], minlength=len(self.target))

    def end(self):
        at = np.flatnonzero(self.raw)
        yield {"bucket": at, "raw": self.raw[at], "target": self.target[at]}


class _Score:
    """Weights of texts, with the columns named ``others``."""

    def __init__(self, ratios: np.ndarray, others: list[str], text: str = "text"):
        self.ratios, self.others, self.text, self.ngrams = ratios, others, text, _Ngrams()

    def __call__(self, batch: pa.RecordBatch):
        for at, texts in words.parts(batch.column(self.text)):
            weights, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for buckets, owner in self.ngrams(texts):
                weights += np.bincount(owner, self.ratios[buckets], len(texts))
                sizes += np.bincount(owner, minlength=len(texts))
            own = {c: batch.column(c).slice(at, len(texts)) for c in self.others}
            yield own | {"log_weight": weights, "n_ngrams": sizes, "scaled": LENGTH * weights / np.maximum(sizes, 1)}


def _labelled(labels: DataFrame, value: int, most: int) -> list:
    """At most ``most`` doc_ids with that label, the same each time: those with the smallest hashes."""
    chosen = labels.where((F.col("quality") == value) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [r[0] for r in chosen.collect()]


def log_ratios(counts: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log ratio of both models for each bucket. ``counts`` has at most FAMILIES * BUCKETS rows."""
    raw, target = (np.zeros(FAMILIES * BUCKETS) for _ in range(2))
    table = counts.toArrow()
    at = table.column("bucket").to_numpy()
    raw[at], target[at] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    out = np.zeros(FAMILIES * BUCKETS)
    for k in range(FAMILIES):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        r, t = raw[part], target[part]
        if t.sum() and r.sum():
            # What the target model would count if it were like the raw one, and what it did count.
            expected = r * (t.sum() / r.sum())
            out[part] = np.log((t + smoothing) / (expected + smoothing))
    return out


def threshold(scores: list[tuple[float, int]]) -> float:
    """The log weight that parts good from bad labelled documents with the least sum of both error rates; midway."""
    good = np.sort([s for s, y in scores if y == 1])
    bad = np.sort([s for s, y in scores if y == 0])
    if not len(good) or not len(bad):
        return -math.inf if not len(bad) else 0.0
    cuts = np.unique(np.concatenate([good, bad]))
    # A lost clean document counts more than a kept bad one.
    cost = 4 * np.searchsorted(good, cuts, "left") / len(good) + 1 - np.searchsorted(bad, cuts, "left") / len(bad)
    k = int(np.argmin(cost))
    return float(cuts[k] if k == 0 else (cuts[k - 1] + cuts[k]) / 2)


def top_k(scored: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, exactly: its bits are found 16 at a time from counts of at most 65,536 groups."""
    values = scored.select(F.col(column).alias("v"))
    prefix, shift = None, 48
    while shift >= 0:
        inside = values if prefix is None else values.where(F.shiftright("v", shift + 16) == prefix)
        groups = inside.groupBy(F.shiftright("v", shift).alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect()
        for g in groups:
            if k <= g.n:
                prefix = g.g
                break
            k -= g.n
        shift -= 16
    return prefix


def uniform_of(doc_id: Column) -> Column:
    return (F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def key_of(scaled: Column, doc_id: Column, temperature: float) -> Column:
    """The weight with Gumbel noise, in millionths, as a long."""
    return F.round((scaled - F.lit(temperature) * F.log(-F.log(uniform_of(doc_id)))) * 1e6).cast("long")


def quality(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, temperature: float = TEMPERATURE, share: float | None = None) -> DataFrame:
    """row, doc_id, log_weight, n_ngrams, scaled, sample_key (in millionths), kept for each row of ``docs`` (doc_id, text; others are ignored).

    The raw model counts all documents, the target model half of those labelled good (at most ``most_labelled``).
    ``log_weight`` is the log ratio of both models' probabilities of the text, ``scaled`` what it would be of a text of
    LENGTH n-grams like it, so that long texts aren't sampled for their length alone. The k documents with the largest
    scaled + temperature * Gumbel noise are kept, a sample without replacement by weight; noise is a hash of doc_id, so
    that reruns agree. k is ``share`` of all documents, or, where that is None, the number that a filter would keep:
    those whose scaled weight is at or over the threshold that parts the labelled documents (that the target model
    wasn't fitted to) best. ``row`` numbers the rows of this result.
    Null and empty texts weigh 0 as any without words; without labels of both kinds nothing is dropped. Ties at the k-th
    place are all kept. Null doc_ids share one noise value; repeated rows are scored each, and count once, by the
    least weight, for the threshold. An empty table gives no rows.
    """
    scored, _, least = _sampled(docs, labels, most_labelled, temperature, share)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))


def _sampled(docs: DataFrame, labels: DataFrame, most_labelled: int, temperature: float, share: float | None):
    """The scored rows with their keys, the log ratios of both models, and the least key that is kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    good, bad = _labelled(labels, 1, most_labelled), _labelled(labels, 0, most_labelled)
    # Half of the good documents fit the target model, the others the threshold: a model favours what it was fitted to.
    targets = spark.sparkContext.broadcast(frozenset(good[::2]))  # at most most_labelled identifiers
    counts = mapped(rows.drop("row"), "bucket long, raw long, target long", lambda: _Count(targets.value)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    ratios = spark.sparkContext.broadcast(log_ratios(counts).astype(np.float32))  # FAMILIES * BUCKETS values
    scored = mapped(rows, "row long, doc_id long, log_weight double, n_ngrams long, scaled double", lambda: _Score(ratios.value, ["row", "doc_id"]))
    scored = scratch.keep(scored.withColumn("sample_key", key_of(F.col("scaled"), F.col("doc_id"), temperature)), "scored")
    known = spark.createDataFrame([(x, 1) for x in good[1::2]] + [(x, 0) for x in bad], "doc_id long, y int")
    labelled = scored.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("scaled").alias("scaled"))  # at most 2 * most_labelled rows
    sample = [(r.scaled, r.y) for r in labelled.collect()]
    cut = threshold(sample) if good and bad else -math.inf
    if share is not None:
        k = round(share * scored.count())
    else:
        k = scored.where(F.col("scaled") >= F.lit(cut)).count() if math.isfinite(cut) else scored.count()
    return scored, ratios, top_k(scored, "sample_key", k) if 0 < k else 1 << 62


def keep_good(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` without those that the classifier rejects, columns unchanged.

    The weights are computed again as the texts are read for the output, which costs less than to store the texts with
    row numbers and shuffle them; they come out the same, as the models are fixed.
    """
    _, ratios, least = _sampled(docs, labels, most_labelled, temperature, None)
    # Columns by number, as names may differ in case alone.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text")}
    schema = StructType([*plain.schema.fields, *[StructField(c, t) for c, t in (("log_weight", DoubleType()), ("n_ngrams", LongType()), ("scaled", DoubleType()))]])
    columns, text = plain.columns, at["text"]
    weighed = mapped(plain, schema, lambda: _Score(ratios.value, columns, text))
    kept = weighed.where(key_of(F.col("scaled"), F.col(at["doc_id"]), temperature) >= F.lit(least))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
