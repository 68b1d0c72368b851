"""MinHash near-duplicates by fast similarity sketching (operator 4).

A sketch has T coordinates. Round i throws all elements of a set into the T bins by a hash of its own, and an
empty bin keeps the smallest hash that falls into it; rounds end when all bins are filled, and after T rounds
bin b takes the smallest of all elements under one more hash. So every coordinate fills, in about
T log T / |set| + 1 passes, and the share of equal coordinates estimates the similarity with the concentration
of independent MinHash. Bands of coordinates give candidates, and whole shingle sets confirm them.

Equal sets are one class. A bucket of m classes isn't expanded into its m * m / 2 pairs: first each class meets
the leader, the smallest of each of its buckets, by whole sets. Two classes x, y with the same leader then differ
in D(x) ^ D(y), where D is what a class's set and the leader's don't share. If one of them lies too far from the
leader to be linked with it, D(x) and D(y) have to share so many elements that prefixes of both meet (elements
that few classes of the leader have come first), which is an exact set-similarity join on the differences. Pairs in
one component already are left out. So the components are those of all candidate pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, mapped, mix, shingles, unused
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 5: a pair at similarity 0.8 is missed with probability 3e-6, at 0.9 with 1e-12.
COORDINATES = 160  # below 256
ROWS_PER_BAND = 5
#: Buckets of the table that counts elements of differences, a bound on what is broadcast.
COUNT_BITS = 20

#: One for each round, of which the later T stand for one bin each.
_SEEDS = mix(np.arange(2 * COORDINATES, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_32, _48, _56 = np.uint64(32), np.uint64(48), np.uint64(56)
_LOW, _REST = np.uint64((1 << 48) - 1), np.uint64((1 << 56) - 1)


def sketch(h: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The T coordinates of a non-empty set of distinct 64-bit hashes.

    As many rounds as usually fill all bins are thrown at once; of what falls into a bin, the first round's
    smallest counts, which one sort by bin, round and hash brings to the front.
    """
    out, empty, n, size = np.zeros(t, np.uint64), np.ones(t, bool), len(h), np.uint64(t)
    done = 0
    while done < t and empty.any():
        rounds = np.arange(done, min(t, done + max(1, -(-6 * t // n))), dtype=np.uint64)
        v = mix(h ^ _SEEDS[rounds.astype(np.intp), None])
        bins = ((v >> _32) * size) >> _32
        keys = np.sort(((bins << _56) | (rounds[:, None] << _48) | (v & _LOW)).ravel())
        at = keys >> _56
        first = np.empty(len(keys), bool)
        first[0] = True
        np.not_equal(at[1:], at[:-1], out=first[1:])
        at, keys = at[first].astype(np.intp), keys[first]
        new = empty[at]
        at = at[new]
        out[at] = mix(keys[new] & _REST)
        empty[at] = False
        done += len(rounds)
    if empty.any():
        b = np.flatnonzero(empty)
        for part in np.array_split(b, max(1, len(b) * n >> 16)):
            out[part] = mix(mix(h ^ _SEEDS[t + part, None]).min(axis=1) ^ _SEEDS[t + part])
    return out


def band_keys(coordinates: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    bands = coordinates.reshape(-1, rows)
    key = _SEEDS[: len(bands)].copy()
    for j in range(rows):
        key = mix(key ^ bands[:, j])
    return key.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space, which is what bytes do."""
    return (text or "").encode().lower().split()


def shingle_sets(texts: pa.Array, k: int):
    """(first text, sorted distinct hashes of the shingles of each text) for runs of texts of a bounded size."""
    for at, some in words.parts(texts):
        h, first, _ = words.split(b"\n".join(some).lower())
        cuts = np.searchsorted(first, np.cumsum([len(t) + 1 for t in some]))
        yield at, [shingles(h[a:b], k) for a, b in zip(np.concatenate([[0], cuts]), cuts, strict=False)]


def _signatures(k: int):
    def make():
        import xxhash

        def run(batch: pa.RecordBatch):
            for at, some in shingle_sets(batch.column("text"), k):
                yield {
                    "doc_id": batch.column("doc_id").slice(at, len(some)),
                    "n_shingles": [len(h) for h in some],
                    "set": [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in some],
                    "bands": lists([band_keys(sketch(h)) if len(h) else None for h in some]),
                }

        return run

    return make


def lists(arrays: list) -> pa.Array:
    """A list column of NumPy arrays of longs; none stands for an empty one."""
    arrays = [np.zeros(0, np.int64) if a is None else a.view(np.int64) for a in arrays]
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(k: int):
    """The whole shingle sets of texts."""

    def make():
        import xxhash

        def run(batch: pa.RecordBatch):
            for _, some in shingle_sets(batch.column("text"), k):
                yield {"set": [xxhash.xxh3_128_digest(h.tobytes()) for h in some], "h": lists(some)}

        return run

    return make


def prefix_length(n: np.ndarray, leader: np.ndarray, d: np.ndarray, linked: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first elements of a difference of size ``d`` have to be indexed.

    A pair at the similarity differs in at most (100 - p) / (100 + p) of the sum of both sizes, and a class that
    isn't linked with the leader differs from it in more than that share of theirs. A partner of a linked class
    isn't linked, so they share over half of d, give or take the sizes; of the classes that aren't, a partner may be.
    """
    half = (d + (n - leader) * (100 - percent) / (100 + percent)) / 2
    most = n * (100 - percent) / percent
    return np.minimum(d, np.floor(np.where(linked, half, most) + 1e-9) + 1).astype(np.int64)


def _prefixes(counts: np.ndarray, percent: int):
    """The entries of the prefix index: per element of a class's prefix its place in it."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            d = batch.column("d")
            values, ends = d.flatten().to_numpy().view(np.uint64), np.asarray(d.offsets)
            ends = ends - ends[0]
            sizes = np.diff(ends)
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb", "group", "linked")}
            length = prefix_length(columns["nb"], columns["na"], sizes, columns["linked"].astype(bool), percent)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            often = counts[slot(values, columns["group"].view(np.uint64)[owner])]
            order = np.lexsort((values, often, owner))
            place = np.arange(len(values)) - np.repeat(ends[:-1], sizes)
            # An element that only one class of the leader has can't be shared; its place still counts.
            wanted = (place < length[owner]) & (often[order] > 1)
            owner, at = owner[wanted], order[wanted]
            taken = {c: batch.column(c).take(pa.array(owner)) for c in ("a", "b", "c", "nb", "linked")}
            return taken | {"element": values[at].view(np.int64), "nd": sizes[owner], "place": place[wanted]}

        return run

    return make


def slot(elements: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Where the count of an element of a leader's classes stands in the table of fixed size."""
    return (mix(elements ^ mix(groups)) >> np.uint64(64 - COUNT_BITS)).astype(np.intp)


class _Counts:
    def __init__(self):
        self.table = np.zeros(1 << COUNT_BITS, np.int64)

    def __call__(self, batch: pa.RecordBatch):
        d = batch.column("d")
        values, sizes = d.flatten().to_numpy().view(np.uint64), np.diff(np.asarray(d.offsets))
        self.table += np.bincount(slot(values, np.repeat(batch.column("group").to_numpy().view(np.uint64), sizes)), minlength=len(self.table))

    def end(self):
        at = np.flatnonzero(self.table)
        yield {"bucket": at, "n": self.table[at]}


def difference_pairs(apart: DataFrame, kind: str, percent: int, scratch: Scratch) -> DataFrame | None:
    """Pairs (a, b) that may be similar among the sets of one leader, one of them at least not linked with it; None if there are none.

    ``apart`` has a row for each leader a and each set b that it has met: their sizes na and nb, whether they are linked,
    the elements d that they don't share, a hash ``group`` of a, and c; sets of equal c needn't meet. ``kind`` is the type of a and b.
    """
    some = apart.groupBy("a").agg(F.count("*").alias("sets"), F.min("linked").alias("all")).where("sets > 1 and not all").select("a")
    apart = apart.join(some, "a", "left_semi")
    counted = mapped(apart.select("group", "d"), "bucket long, n long", _Counts).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** COUNT_BITS rows
    if not counted.num_rows:
        return None
    table = np.zeros(1 << COUNT_BITS, np.int32)
    table[counted.column("bucket").to_numpy()] = np.minimum(counted.column("n").to_numpy(), 1 << 30)
    often = apart.sparkSession.sparkContext.broadcast(table)
    columns = f"a {kind}, b {kind}, c long, nb int, linked boolean, element long, nd int, place int"
    entries = mapped(apart.select("a", "b", "c", *[F.col(c).cast("int").alias(c) for c in ("na", "nb")], "linked", "group", "d"), columns, lambda: _prefixes(often.value, percent)())
    entries = scratch.keep(entries, "entries")
    x = entries.select("a", "element", F.col("b").alias("x"), F.col("c").alias("cx"), F.col("nb").alias("nx"), F.col("nd").alias("dx"), F.col("place").alias("ix"), F.col("linked").alias("lx"))
    y = entries.select("a", "element", F.col("b").alias("y"), F.col("c").alias("cy"), F.col("nb").alias("ny"), F.col("nd").alias("dy"), F.col("place").alias("iy"), F.col("linked").alias("ly"))
    # Elements of the differences that the pair has to share, and what the places leave possible.
    need = (F.col("dx") + F.col("dy") - (F.col("nx") + F.col("ny")) * (100 - percent) / (100 + percent)) / 2 - 1e-6
    near = ~F.col("lx") & (F.col("ly") | (F.col("x") < F.col("y"))) & (F.col("cx") != F.col("cy"))
    near = near & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    near = near & (F.least(F.col("dx") - F.col("ix"), F.col("dy") - F.col("iy")) >= need)
    rest = scratch.keep(x.join(y, ["a", "element"]).where(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "rest")
    return None if rest.isEmpty() else rest


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents with a Jaccard similarity of at least ``similarity`` on their sets of ``words``-word shingles are
    linked; component_id is the smallest doc_id reachable, and kept says that it is the row's own. Texts
    without words, and null texts, link with nothing. Rows with a null doc_id take no part: null component_id,
    kept. Rows that share a doc_id are one document, linked with whatever any of them is. An empty table gives no rows.
    """
    spark, percent = docs.sparkSession, round(100 * similarity)
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(mapped(rows, "doc_id long, n_shingles long, set binary, bands array<long>", _signatures(words)), "signed")
    known = signed.where(F.col("doc_id").isNotNull())
    classes = scratch.keep(known.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands")), "classes")
    # A class is known by its set, and as a node by its smallest doc_id, so a document with several texts joins theirs.
    several = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("set").alias("with"), F.min("set").alias("low"), F.max("set").alias("high"))
    several = several.where("rows > 1 and (low <> high or (with > 0 and with < rows))").select("doc_id")
    same = known.join(several, "doc_id").join(classes.select("set", "rep"), "set").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    same = scratch.keep(same.distinct(), "several")

    # Each class and the leader of each of its buckets.
    banded = classes.select(F.struct("rep", "set").alias("node"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1")
    met = banded.join(shared, "key").where("node <> leader").select(F.col("leader.set").alias("a"), F.col("node.set").alias("b")).distinct()
    met = scratch.keep(met, "met")
    nodes = met.select(F.col("a").alias("set")).unionByName(met.select(F.col("b").alias("set"))).distinct()
    nodes = scratch.keep(nodes.join(classes.select("set", "rep", "n"), "set"), "nodes")
    # A document with several texts gives sets that nobody asked for, which the join leaves out.
    texts = rows.join(nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = mapped(texts, "set binary, h array<long>", _sets(words)).dropDuplicates(["set"])
    sets = scratch.keep(nodes.join(sets, "set"), "sets")

    both = F.size(F.array_intersect("ha", "hb"))
    linked = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))

    def sides(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("set").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("h").alias("ha"))
        right = sets.select(F.col("set").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("h").alias("hb"))
        return pairs.join(right, "b").join(left, "a")

    first = sides(met).withColumn("both", both).withColumn("linked", linked)
    first = first.withColumn("d", F.concat(F.array_except("hb", "ha"), F.array_except("ha", "hb")))
    first = scratch.keep(first.select("a", "b", "ra", "rb", "na", "nb", "linked", "d", F.xxhash64("a").alias("group")), "first")
    links = first.where("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(same)
    comps = scratch.keep(components(links, scratch, "c1"), "components-1")

    # Leaders some of whose classes are still apart, one of them at least not linked with the leader.
    placed = first.select("a", "b", "rb", "na", "nb", "linked", "group", "d").join(comps.select(F.col("node").alias("rb"), "component"), "rb", "left").withColumn("c", F.coalesce("component", "rb"))
    open_groups = placed.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("linked").alias("all")).where("low <> high and not all").select("a")
    apart = scratch.keep(placed.join(open_groups, "a", "left_semi").select("a", "b", "c", "na", "nb", "linked", "group", "d"), "apart")
    rest = difference_pairs(apart, "binary", percent, scratch)
    if rest is not None:
        second = sides(rest).withColumn("both", both).where(linked).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        second = scratch.keep(second, "second")
        if not second.isEmpty():
            comps = scratch.keep(components(links.unionByName(second), scratch, "c2"), "components-2")

    label = comps.select("node", "component")
    by_set = classes.select("set", "rep").join(label, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("component"))
    # A row without words has no class, but another row of its document may have one.
    bare = several.join(label, F.col("doc_id") == F.col("node")).select("doc_id", "component")
    out = known.where(F.col("set").isNotNull()).join(by_set, "set").select("doc_id", "n_shingles", "component")
    out = out.unionByName(known.where(F.col("set").isNull()).join(bare, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")))
    out = out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    nobody = signed.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return scratch.last(out.unionByName(nobody))


def drop_near(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, columns unchanged."""
    name = unused(docs, "dropped_id")
    dropped = near_dedup(docs, words, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col(name), "left_anti")
