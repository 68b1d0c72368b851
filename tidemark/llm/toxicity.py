"""Toxicity by multiple-instance learning (operator 7).

A document is a bag of sentences. Each sentence has a logistic score on hashed features of its words, less a share
of the logarithm of the document's sentences, and the document's score is their noisy-or: one minus the product of
one minus each. Training sees document labels only; the sentence scores that it finds tell where the offending
sentences are. Only features that documents of one label have far oftener than those of the other are learned, and
the bias is set on documents that the weights weren't fitted to.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped
from .lexicon import Lexicon

FEATURE_BITS = 18
#: Lengths of the beginnings of words that are features, beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Bounds on the labelled documents of each class that the model is fitted to.
MOST_TOXIC = 1500
MOST_CLEAN = 3000
STEPS = 100
RATE = 0.05
DECAY = 1e-6
START = -7.0
#: What the logarithm of the number of sentences takes from a sentence's score to begin with; it is learned.
LENGTH_START = 0.7
#: Features of fewer training documents than this aren't used: they would learn documents, not words.
LEAST_DOCUMENTS = 5
#: Nor are those whose likelihood ratio statistic between the labels (chi-squared of one degree) is less than this.
LEAST_STATISTIC = 20.0
#: Parts of the training documents; each is scored by a model of the others to set the bias.
FOLDS = 3

_ENDS = bytes.maketrans(b"!?\n\r", b"....")
_TRIM = b".,;:!?\"'()[]{}*#%&$|<>-_"
_NEVER = -20.0


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) in UTF-8 bytes for each sentence that has words; ends are . ! ? and line breaks."""
    data = (text or "").encode()
    out, at = [], 0
    for part in data.lower().translate(_ENDS).split(b"."):
        words = {w for w in (x.strip(_TRIM) for x in part.split()) if w}
        if words:
            out.append((at, at + len(part), sorted(words)))
        at += len(part) + 1
    return out


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of the word and of its beginnings; a beginning longer than the word is the word."""
    import xxhash

    text, of = word.decode(errors="replace"), xxhash.xxh3_64_intdigest
    return tuple(of(x) >> (64 - FEATURE_BITS) for x in ("w" + text, *(f"{k}{text[:k]}" for k in BEGINNINGS)))


def _held_features():
    """The distinct features of each document."""
    lexicon = Lexicon([lambda w, k=k: features(w)[k] for k in range(1 + len(BEGINNINGS))], [np.int32] * (1 + len(BEGINNINGS)))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            words = sorted({w for _, _, own in sentences(text) for w in own})
            out.append(np.unique(np.concatenate(lexicon(words))))
        return {"toxic": batch.column("toxic"), "fold": batch.column("fold"), "features": out}

    return run


class _Hot:
    """The used features of a sentence's words, a bounded number of words being remembered."""

    def __init__(self, used):
        self.used, self.known = used, {}

    def __call__(self, words: list[bytes]) -> tuple[int, ...]:
        known, hot = self.known, set()
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) >= 200_000:
                    known.clear()
                x = known[w] = tuple({f for f in features(w) if f in self.used})
            if x:
                hot.update(x)
        return tuple(sorted(hot))


def _bags(places: dict[int, int]):
    """Each document's distinct sets of used features, by their places, and how many sentences have each."""
    hot = _Hot(places)

    def run(batch: pa.RecordBatch) -> dict:
        columns = {"features": [], "ends": [], "times": []}
        for text in batch.column("text").to_pylist():
            times: dict[tuple, int] = {}
            for _, _, words in sentences(text):
                own = hot(words)
                times[own] = times.get(own, 0) + 1
            columns["features"].append([places[f] for own in times for f in own])
            columns["ends"].append(np.cumsum([len(own) for own in times], dtype=np.int32))
            columns["times"].append(list(times.values()))
        return {"toxic": batch.column("toxic"), "fold": batch.column("fold"), **columns}

    return run


def statistic(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Twice the gain in log likelihood of a rate for each label over one for both, of features by their documents."""

    def part(count, of, rate):
        return np.where(count > 0, count * np.log(np.maximum(count, 1) / max(of, 1) / np.maximum(rate, 1e-12)), 0.0)

    rate = (toxic + clean) / max(1, n_toxic + n_clean)
    yes = part(toxic, n_toxic, rate) + part(clean, n_clean, rate)
    no = part(n_toxic - toxic, n_toxic, 1 - rate) + part(n_clean - clean, n_clean, 1 - rate)
    return 2 * (yes + no)


def useful(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell of toxic documents, and the shrunk log odds of all."""
    odds = np.log((toxic + 2) / (n_toxic + 4)) - np.log((clean + 2) / (n_clean + 4))
    return (toxic + clean >= LEAST_DOCUMENTS) & (odds > 0) & (statistic(toxic, clean, n_toxic, n_clean) >= LEAST_STATISTIC), odds


class Bags:
    """Labelled documents as arrays: for each distinct set of features its document, features and number of sentences."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        rows = [r for r in rows if len(r[2])]
        self.y = np.array([r[0] for r in rows], float)
        sets = np.array([len(r[2]) for r in rows], np.int64)
        self.first = np.cumsum(sets) - sets
        self.docs = np.repeat(np.arange(len(rows)), sets)
        self.times = np.concatenate([np.zeros(0), *(r[3] for r in rows)])
        self.length = np.log(np.bincount(self.docs, self.times, len(rows)))[self.docs]
        self.ids = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in rows)]).astype(np.int64)
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(r[2], prepend=0) for r in rows)])
        self.sets = np.repeat(np.arange(len(sizes)), sizes)

    def scores(self, model: np.ndarray) -> np.ndarray:
        """Log odds of the sets' sentences; the model's last two values are bias and weight of the length."""
        return model[-2] - model[-1] * self.length + np.bincount(self.sets, model[self.ids], len(self.docs))

    def none(self, z: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the chance that no sentence of a document is toxic."""
        return np.add.reduceat(self.times * np.logaddexp(0, z), self.first) if len(self.first) else np.zeros(0)


def fit(bags: Bags, used: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Weights of the features, bias and weight of the length, by Adam on the log loss; the weights start at the log odds."""
    model = np.concatenate([np.where(used & (odds > 1.5), 0.7 * odds, 0.0), [START, LENGTH_START]])
    y = bags.y
    if not y.any():
        model[:] = 0.0
        model[-2] = _NEVER
        return model
    # Both classes count alike, or a few short toxic texts would be given up for the many clean ones.
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    m, v = np.zeros_like(model), np.zeros_like(model)
    for step in range(1, STEPS + 1):
        z = np.clip(bags.scores(model), -30, 30)
        none = np.exp(-bags.none(z))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = bags.times / (1 + np.exp(-z)) * (pull * share)[bags.docs]
        weights = np.bincount(bags.ids, g[bags.sets], len(used)) + DECAY * model[:-2]
        grad = np.concatenate([np.where(used, weights, 0.0), [g.sum(), -(g * bags.length).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        model -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def best_shift(parts: list[tuple[Bags, np.ndarray]]) -> float:
    """What to add to the bias, so that the log loss of documents under models of other documents is least."""
    scored = [(b, b.scores(model)) for b, model in parts]

    def loss(shift: float) -> float:
        total = 0.0
        for b, z in scored:
            none = np.clip(np.exp(-b.none(np.clip(z + shift, -60, 60))), 1e-4, 1 - 1e-4)
            total -= np.log(np.where(b.y == 1, 1 - none, none)).sum()
        return total

    return min(np.arange(-4, 8.01, 0.25).tolist(), key=loss)


class _Score:
    def __init__(self, weights: dict[int, float], bias: float, length: float):
        self.weights, self.bias, self.length = weights, bias, length
        self.hot = _Hot(weights)

    def __call__(self, batch: pa.RecordBatch) -> dict:
        scores, spans = [], []
        for text in batch.column("text").to_pylist():
            parts = sentences(text)
            base = self.bias - self.length * np.log(max(1, len(parts)))
            hot = [self.hot(words) for _, _, words in parts]
            z = np.clip(np.array([base + sum(self.weights[f] for f in own) for own in hot], float), -60, 60)
            score = float(-np.expm1(-np.logaddexp(0, z).sum()))
            p = 1 / (1 + np.exp(-z))
            scores.append(score)
            found = [k for k in np.flatnonzero(2 * p >= p.max(initial=0)) if hot[k]] if score >= 0.5 else []
            spans.append([{"start": parts[k][0], "end": parts[k][1], "score": float(p[k])} for k in found])
        return {"doc_id": batch.column("doc_id"), "score": scores, "offending": spans}


def train(texts: DataFrame) -> tuple[dict[int, float], float, float]:
    """Feature weights, bias and weight of the length from a bounded number of texts (text, toxic, fold)."""
    sums = [F.sum(((F.col("fold") == k) & (F.col("toxic") == y)).cast("int")).alias(f"n{y}{k}") for y in (1, 0) for k in range(FOLDS)]
    totals = {k: v or 0 for k, v in texts.agg(*sums).first().asDict().items()}
    held = mapped(texts, "toxic int, fold int, features array<int>", _held_features)
    counts = held.select("toxic", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(*sums, F.count("*").alias("n"))
    # At most 2 ** FEATURE_BITS rows.
    table = counts.where(F.col("n") >= LEAST_DOCUMENTS).orderBy("feature").toArrow()
    ids = table.column("feature").to_numpy()

    def chosen(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        folds = [k for k in range(FOLDS) if k != without]
        n1, n0 = (sum(totals[f"n{y}{k}"] for k in folds) for y in (1, 0))
        toxic, clean = (np.sum([table.column(f"n{y}{k}").to_numpy() for k in folds], axis=0, dtype=float) for y in (1, 0))
        return useful(toxic, clean, n1, n0)

    picks = {k: chosen(k) for k in (None, *range(FOLDS))}
    places = {int(f): k for k, f in enumerate(ids)}
    some = {int(ids[k]) for k in np.flatnonzero(np.any([used for used, _ in picks.values()], axis=0))}
    places = {f: k for f, k in places.items() if f in some}
    bags = mapped(texts, "toxic int, fold int, features array<int>, ends array<int>, times array<int>", lambda: _bags(places)).toArrow()
    arrays = [bags.column(c) for c in ("features", "ends", "times")]
    rows = [(y, *(a.values.to_numpy() for a in row)) for y, *row in zip(bags.column("toxic").to_pylist(), *arrays, strict=True)]
    fold = np.array(bags.column("fold").to_pylist(), int)
    model = fit(Bags(rows), *picks[None])
    if all(sum(totals[f"n{y}{k}"] for k in range(FOLDS) if k != j) for y in (1, 0) for j in range(FOLDS)):
        parts = [[r for r, f in zip(rows, fold, strict=True) if (f == k) == own] for k in range(FOLDS) for own in (True, False)]
        models = [(Bags(parts[2 * k]), fit(Bags(parts[2 * k + 1]), *picks[k])) for k in range(FOLDS)]
        model[-2] += best_shift(models)
    return {int(ids[k]): float(model[k]) for k in np.flatnonzero(model[:-2])}, float(model[-2]), float(model[-1])


def toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for each row of ``docs`` (doc_id, text; others are ignored).

    held_out: the CRC-32 of doc_id as text is divisible by 5; such labels aren't learned from. Of the others at most
    ``most_toxic`` and ``most_clean`` documents, those with the smallest hashes, fit the model; of rows
    that share a doc_id it sees the greatest text. offending lists, for
    documents with a score of at least one half, the sentences (byte offsets in UTF-8) that hold a learned feature and
    score at least half of the document's highest sentence. Null, empty and wordless texts score 0;
    without toxic labels all scores are near 0. Null doc_ids aren't held out, and their rows and repeated ones are
    scored each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    chosen = [(r.doc_id, r.toxic) for p in parts for r in p.collect()]
    known = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))  # at most most_toxic + most_clean rows
    learned = rows.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    texts = scratch.keep(learned.select("text", "toxic", F.pmod(F.hash("doc_id"), F.lit(FOLDS)).alias("fold")), "texts")
    model = spark.sparkContext.broadcast(train(texts))  # at most 2 ** FEATURE_BITS weights
    scratch.drop("texts")
    out = mapped(rows, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>", lambda: _Score(*model.value))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
