"""Line dedup by an exact set-similarity join (operator 3).

Lines are sets of words. Words are ordered by rarity, counted in a table of fixed size by hash, so that the order
is one for all lines however large the vocabulary. Two lines that are similar enough share a word among the first
few of each (prefix filter); length, position and a bitmap bound their overlap further, and the whole sets decide.
Equal sets are one class with one first line.

Texts are split and hashed by arrays, three times: for the lines and the counts, for the prefixes, and for the whole
sets of candidates, which costs less than to store all sets. Entries of the prefix index travel in blocks that hold
a part of the words each, so that a part's entries are sorted and compared as arrays. A word that very many lines
have isn't compared pair by pair: each of its lines meets the earliest one, its leader, and what is not similar to
that meets the others by a prefix join on the differences from the leader, as near_dedup does it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, in_small_batches, mapped, mix, numbered
from .near_dedup import COUNT_BITS, difference_pairs

SIMILARITY = 0.8
#: Sets that a task remembers.
MOST_SEEN = 200_000
_SHIFT = np.uint64(64 - COUNT_BITS)
_SLICE_BITS = 14
#: A word that more sets have in their prefix is met by leaders at once.
COMMON = 16_384
#: A word counted in so many lines isn't sent to a part at all; a part's groups never exceed it.
VERY_COMMON = 1 << 20
#: A word whose lines give more candidates each, on average, is met by leaders too.
MOST_EACH = 2
#: Entries of a part, about.
PART_ENTRIES = 1 << 18

#: What a row of the table of lines is: a line (its number), a document, or a slice of word counts.
DOCUMENT, COUNTS = -1, -2
LINES = "row long, doc_id long, line int, n int, k long, bits long, counts binary"
ENTRY = np.dtype([("word", "<u8"), ("k", "<u8"), ("bits", "<u8"), ("more", "<u8"), ("n", "<u4"), ("place", "<u4")])


def line_sets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lines that have words, sizes of their sets, and word hashes, ascending in each line; A-Z lower-cased."""
    h, first, _ = words.split(data.lower())
    if not len(h):
        return first, first, h
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    counts = np.diff(np.searchsorted(first, breaks), prepend=0, append=len(h))
    line = np.repeat(np.arange(len(counts)), counts)
    key = (line.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    order = np.argsort(key)
    sorted_h, sorted_line = h[order], line[order]
    key = key[order]
    if line[-1] >= 1 << 20 or ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        order = np.lexsort((h, line))
        sorted_h, sorted_line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_line[1:] != sorted_line[:-1])
    h, line = sorted_h[new], sorted_line[new]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return line[starts], np.diff(np.concatenate([starts, [len(line)]])), h


def set_keys(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set a sum of hashes and a bitmap, which together are its identity and depend on no order.

    A bit tells whether the set has an odd number of words of that bit, so the bitmaps of two sets differ in no more
    bits than the sets in words, however many words they have.
    """
    return np.add.reduceat(mix(flat), starts), parities(flat, starts, 0)


def parities(flat: np.ndarray, starts: np.ndarray, half: int) -> np.ndarray:
    """One of the two halves of the bitmaps; each word has one bit in one of them."""
    own = ((flat >> np.uint64(6)) & np.uint64(1)) == half
    return np.bitwise_xor.reduceat(own.astype(np.uint64) << (flat & np.uint64(63)), starts)


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from 64-bit words, so many a row."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


class _Texts:
    """Sets of the lines of texts, batches by parts of a bounded size."""

    def parts(self, batch: pa.RecordBatch):
        """(first text, texts, lines of each text, their texts, numbers, sizes, hashes, k, bits) for runs of texts of a batch."""
        for at, texts in words.parts(batch.column("text")):
            n_lines = np.array([t.count(b"\n") + 1 for t in texts])
            numbers, sizes, flat = line_sets(b"\n".join(texts))
            starts = np.cumsum(n_lines) - n_lines
            owner = np.searchsorted(starts, numbers, "right") - 1
            k, bits = set_keys(flat, np.cumsum(sizes) - sizes) if len(sizes) else (np.zeros(0, np.uint64),) * 2
            yield at, len(texts), n_lines, owner, numbers - starts[owner], sizes, flat, k, bits


class _Lines(_Texts):
    """The table of lines; the task's counts come last."""

    def __init__(self):
        self.table = np.zeros(1 << COUNT_BITS, np.int64)

    def __call__(self, batch: pa.RecordBatch):
        rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
        for first, m, n_lines, owner, numbers, sizes, flat, k, bits in self.parts(batch):
            self.table += np.bincount((flat >> _SHIFT).astype(np.intp), minlength=len(self.table))
            at, none = first + np.concatenate([owner, np.arange(m)]), np.zeros(m, np.int64)
            yield {
                "row": rows[at],
                "doc_id": ids.take(pa.array(at)),
                "line": np.concatenate([numbers, np.full(m, DOCUMENT)]),
                "n": np.concatenate([sizes, n_lines]),
                "k": np.concatenate([k.view(np.int64), none]),
                "bits": np.concatenate([bits.view(np.int64), none]),
                "counts": pa.nulls(len(at), pa.binary()),
            }

    def end(self):
        parts = self.table.reshape(-1, 1 << _SLICE_BITS)
        at = np.flatnonzero(parts.any(axis=1))
        none = np.zeros(len(at), np.int64)
        yield {"row": at, "doc_id": none, "line": none + COUNTS, "n": none, "k": none, "bits": none, "counts": pa.array([parts[a].tobytes() for a in at], pa.binary())}


class _Sets(_Texts):
    """The whole sets of the lines that a table of bits marks, those of one task once as far as its memory goes."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, self.seen = wanted, set()

    def __call__(self, batch: pa.RecordBatch):
        for *_, sizes, flat, k, bits in self.parts(batch):
            new = self.wanted[(mix(k) >> _SHIFT).astype(np.intp)] & unseen(self.seen, k, bits)
            yield {"k": k[new].view(np.int64), "bits": bits[new].view(np.int64), "words": binaries(flat[np.repeat(new, sizes)], sizes[new])}


def unseen(seen: set, k: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which sets weren't met before; a set of bounded size remembers them."""
    new = np.zeros(len(k), bool)
    for at, key in enumerate(zip(k.tolist(), bits.tolist(), strict=True)):
        if key not in seen:
            new[at] = True
            if len(seen) < MOST_SEEN:
                seen.add(key)
    return new


def _marks():
    def run(batch: pa.RecordBatch) -> dict:
        k = batch.column("k").to_numpy(zero_copy_only=False).view(np.uint64)
        return {"bucket": np.unique(mix(k) >> _SHIFT).astype(np.int64)}

    return run


class _Sums:
    """Sums of slices of counts, one row a slice."""

    def __init__(self):
        self.tables = {}

    def __call__(self, batch: pa.RecordBatch):
        for at, part in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            add = np.frombuffer(part, np.int64)
            self.tables[at] = self.tables[at] + add if at in self.tables else add

    def end(self):
        yield {"row": list(self.tables), "counts": [t.tobytes() for t in self.tables.values()]}


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


class _Entries(_Texts):
    """Blocks of index entries by part, and under negative parts the entries of very common words."""

    def __init__(self, counts: np.ndarray, percent: int, part_bits: int, very_common: int):
        self.counts, self.percent, self.part_bits, self.very_common, self.seen = counts, percent, part_bits, very_common, set()

    def __call__(self, batch: pa.RecordBatch):
        for *_, sizes, flat, k, bits in self.parts(batch):
            new = unseen(self.seen, k, bits)
            entries, often = self.entries(flat[np.repeat(new, sizes)], sizes[new], k[new], bits[new])
            part = (mix(entries["word"]) >> np.uint64(64 - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(entries), np.int64)
            # Blocks of very common words are only handed on, dealt at random.
            part[often > self.very_common] = -1 - int(k[:1].sum() >> np.uint64(40))
            by = np.argsort(part, kind="stable")
            part, entries = part[by], entries[by]
            firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            blocks = np.split(entries, firsts[1:])
            yield {"part": part[firsts] if len(part) else [], "block": [b.tobytes() for b in blocks if len(b)]}

    def entries(self, flat, sizes, k, bits) -> tuple[np.ndarray, np.ndarray]:
        """The entries of lines, whose hashes ascend, and how often their words occur."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        often = self.counts[(flat >> _SHIFT).astype(np.intp)]
        # By line, then count; a stable sort leaves equal counts by hash.
        order = np.argsort((owner << 31) | often, kind="stable")
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # A word that only one line has can't be shared; its place in the prefix still counts.
        wanted = (place < prefix_sizes(sizes, self.percent)[owner]) & (often[order] > 1)
        order, line = order[wanted], owner[wanted]  # the order keeps lines together
        out = np.empty(len(order), ENTRY)
        out["word"], out["k"], out["bits"], out["n"], out["place"] = flat[order], k[line], bits[line], sizes[line], place[wanted]
        if len(sizes):
            out["more"] = parities(flat, np.cumsum(sizes) - sizes, 1)[line]
        return out, often[order]


PAIRS = "word long, ka long, ba long, na long, kb long, bb long, nb long"


def possible(nx, ix, bx, mx, ny, iy, by, my, percent: int) -> np.ndarray:
    """Whether length, places and bitmaps of two entries of a word leave the overlap possible that the similarity needs."""
    need = (nx + ny) * (percent / (100 + percent)) - 1e-9
    differ = np.bitwise_count(bx ^ by).astype(np.int64) + np.bitwise_count(mx ^ my)
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - ix, ny - iy) >= need) & ((nx + ny - differ) / 2 >= need)


def candidates(entries: np.ndarray, percent: int, most_each: float, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of entries of one word that may be similar, and which entries are of words that go by leaders.

    Those are all entries of a word that more than ``common`` have, and those with a partner of a word that gives too many pairs.
    Entries are sorted by word and n, so that a partner lies few places on. Pairs are kept of a word until it gave too many.
    """
    word, n, i, bits = entries["word"], entries["n"].astype(np.int64), entries["place"].astype(np.int64), entries["bits"].copy()
    more = entries["more"].copy()
    group = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
    sizes = np.bincount(group)
    most, crowded = most_each * sizes, sizes > common
    given, partner = np.zeros(len(most), np.int64), crowded[group]
    none, step = np.zeros(0, np.intp), 1
    left, right, at = [none], [none], np.flatnonzero(~partner)
    while True:
        at = at[at + step < len(entries)]
        to = at + step
        on = (group[at] == group[to]) & (percent * n[to] <= 100 * n[at])
        at, to = at[on], to[on]
        if not len(at):
            break
        good = possible(n[at], i[at], bits[at], more[at], n[to], i[to], bits[to], more[to], percent)
        if good.any():
            a, b = at[good], to[good]
            partner[a] = partner[b] = True
            few = ~crowded[group[a]]
            a, b = a[few], b[few]
            left.append(a)
            right.append(b)
            given += np.bincount(group[a], minlength=len(most))
            crowded |= given > most
        step += 1
    left, right = np.concatenate(left), np.concatenate(right)
    on = ~crowded[group[left]]
    return left[on], right[on], crowded[group] & partner


def once(entries: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of sets once, whichever words it was found by."""
    order = np.lexsort((entries["bits"], entries["k"]))
    ordered = entries[["k", "bits"]][order]
    number = np.empty(len(entries), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    _, first = np.unique(number[a] * len(entries) + number[b], return_index=True)
    return a[first], b[first]


def _meet(percent: int, most_each: float, common: int):
    """A part's candidate pairs; of a word that goes by leaders, its entries instead, as pairs without a second."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(b, ENTRY) for b in table.column("block").to_pylist()])
        alone, a, b = entries, (none := np.zeros(0, np.intp)), none
        if key[0].as_py() >= 0:
            # The same set may come from several tasks.
            entries = entries[np.lexsort((entries["bits"], entries["k"], entries["n"], entries["word"]))]
            entries = entries[np.concatenate([[True], entries[1:] != entries[:-1]])]
            a, b, crowded = candidates(entries, percent, most_each, common)
            (a, b), alone = once(entries, a, b), entries[crowded]
        x, y = np.concatenate([entries[a], alone]), entries[b]
        missing = pa.nulls(len(alone), pa.int64())
        second = {c: pa.concat_arrays([pa.array(y[f].astype(np.uint64).view(np.int64)), missing]) for c, f in (("kb", "k"), ("bb", "bits"), ("nb", "n"))}
        first = {c: pa.array(x[f].astype(np.uint64).view(np.int64)) for c, f in (("word", "word"), ("ka", "k"), ("ba", "bits"), ("na", "n"))}
        out = first | second
        return pa.table({c: out[c] for c in ("word", "ka", "ba", "na", "kb", "bb", "nb")})

    return run


def _verified(percent: int):
    """Of pairs of whole sets, those at the similarity."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            good = []
            for at, (wx, wy) in enumerate(zip(batch.column("wx").to_pylist(), batch.column("wy").to_pylist(), strict=True)):
                a, b = np.frombuffer(wx, np.uint64), np.frombuffer(wy, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    good.append(at)
            at = pa.array(good, pa.int64())
            return {"k": batch.column("k").take(at), "bits": batch.column("bits").take(at)}

        return run

    return make


APART = "a string, b string, c long, na long, nb long, linked boolean, group long, d array<long>"


def _differences(percent: int):
    """Each line's set against its leader's: whether they are similar, and what they don't share."""

    def make():
        from .near_dedup import lists

        def run(batch: pa.RecordBatch) -> dict:
            linked, d = [], []
            for wx, wy in zip(batch.column("wx").to_pylist(), batch.column("wy").to_pylist(), strict=True):
                x, y = np.frombuffer(wx, np.uint64), np.frombuffer(wy, np.uint64)
                d.append(np.setxor1d(x, y, assume_unique=True))
                both = (len(x) + len(y) - len(d[-1])) // 2
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            return {c: batch.column(c) for c in ("a", "b", "c", "na", "nb", "group")} | {"linked": linked, "d": lists(d)}

        return run

    return make


@in_small_batches
def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, row: str | None = None, common: int = COMMON, most_each: float = MOST_EACH, very_common: int = VERY_COMMON) -> DataFrame:
    """row, doc_id, n_lines, removed for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``removed`` lists the numbers, from 0, of the lines whose set of words has a Jaccard similarity of at least
    ``similarity`` with that of any earlier line; documents are in the order of doc_id (null last), then of row,
    the column that ``row`` names and that has to be written; without one a row id is given as texts are split.
    ``common``, ``most_each`` and ``very_common`` say which words' lines are met by leaders, which changes no result.
    Lines without words are never removed. Null and empty texts have one line; an empty table gives no rows.
    """
    spark, percent = docs.sparkSession, round(100 * similarity)
    scratch = Scratch(spark, "lines")
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, texts = scratch.keep(mapped(rows, LINES, _Lines), "lines"), docs.select("text")
    lines, own = table.where("line >= 0").select("row", "doc_id", "line", "n", "k", "bits"), ["k", "bits"]
    summed = mapped(table.where(F.col("line") == COUNTS).select("row", "counts").repartition("row"), "row long, counts binary", _Sums).toArrow()  # 2 ** COUNT_BITS counts
    counts = np.zeros((1 << COUNT_BITS - _SLICE_BITS, 1 << _SLICE_BITS), np.int64)
    for at, part in zip(summed.column("row").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        counts[at] = np.frombuffer(part, np.int64)
    often = spark.sparkContext.broadcast(np.minimum(counts.ravel(), 1 << 30).astype(np.int32))
    held = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    entries = (100 - percent) * held[1] // 100 + held[0]
    part_bits = max(0, int(entries // PART_ENTRIES).bit_length())
    blocks = mapped(texts, "part long, block binary", lambda: _Entries(often.value, percent, part_bits, very_common))
    met = scratch.keep(blocks.groupBy("part").applyInArrow(_meet(percent, most_each, common), PAIRS), "met")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    classes = scratch.keep(lines.groupBy(*own).agg(F.min(place).alias("place"), F.count("*").alias("copies")), "classes")

    # The whole sets of all lines that a pair holds, or a very common word.
    first, second = met.select(F.col("ka").alias("k"), F.col("ba").alias("bits")), met.where("kb is not null").select(F.col("kb").alias("k"), F.col("bb").alias("bits"))
    nodes = scratch.keep(first.unionByName(second).distinct().join(classes.drop("copies"), own), "nodes")
    marks = np.zeros(1 << COUNT_BITS, bool)
    found = mapped(nodes.select("k"), "bucket long", _marks).distinct().toArrow()  # at most 2 ** COUNT_BITS rows
    marks[found.column("bucket").to_numpy()] = True
    wanted = spark.sparkContext.broadcast(marks)
    sets = scratch.keep(mapped(texts, "k long, bits long, words binary", lambda: _Sets(wanted.value)).join(nodes, own).dropDuplicates(own), "sets")
    x = sets.select(F.col("k").alias("ka"), F.col("bits").alias("ba"), F.col("place").alias("px"), F.col("words").alias("wx"))
    y = sets.select(F.col("k").alias("kb"), F.col("bits").alias("bb"), F.col("place").alias("py"), F.col("words").alias("wy"))

    def gone(pairs: DataFrame, name: str) -> DataFrame:
        """Of each similar pair the later one."""
        sides = pairs.join(x, ["ka", "ba"]).join(y, ["kb", "bb"])
        later = [F.when(F.col("px") < F.col("py"), F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("ka", "kb", "k"), ("ba", "bb", "bits"))]
        return scratch.keep(mapped(sides.select(*later, "wx", "wy"), "k long, bits long", _verified(percent)).distinct(), name)

    removed = gone(met.where("kb is not null").select("ka", "ba", "kb", "bb").distinct(), "gone-1")
    common = scratch.keep(met.where("kb is null").select("word", F.col("ka").alias("k"), F.col("ba").alias("bits"), F.col("na").alias("n")).distinct(), "common")
    scratch.drop("met")
    if not common.isEmpty():
        known = common.join(nodes, own)
        leaders = known.groupBy("word").agg(F.min(F.struct("place", "k", "bits", "n")).alias("l"))
        pairs = known.join(leaders, "word").where("k <> l.k or bits <> l.bits")
        pairs = pairs.select(F.col("l.k").alias("ka"), F.col("l.bits").alias("ba"), F.col("l.n").alias("na"), F.col("k").alias("kb"), F.col("bits").alias("bb"), F.col("n").alias("nb")).distinct()
        sides = pairs.join(y.drop("py"), ["kb", "bb"]).join(x.drop("px"), ["ka", "ba"])
        sides = sides.select(F.concat_ws(",", "ka", "ba").alias("a"), F.concat_ws(",", "kb", "bb").alias("b"), F.xxhash64("kb", "bb").alias("c"), "na", "nb", F.xxhash64("ka", "ba").alias("group"), "wx", "wy")
        apart = scratch.keep(mapped(sides, APART, _differences(percent)), "apart")
        ends = lambda c: [F.split(c, ",")[j].cast("long") for j in range(2)]
        near = apart.where("linked").select(*[e.alias(c) for e, c in zip(ends("b"), own, strict=True)])
        rest = difference_pairs(apart, "string", percent, scratch)
        if rest is not None:
            rest = rest.select(*[e.alias(c) for s, cs in (("a", ("ka", "ba")), ("b", ("kb", "bb"))) for e, c in zip(ends(s), cs, strict=True)])
            near = near.unionByName(gone(rest, "gone-2"))
        removed = removed.unionByName(near).distinct()
    # A line goes if it isn't its class's first, or if its class has an earlier partner.
    firsts = classes.select(*own, "copies", F.col("place.row").alias("first_row"), F.col("place.line").alias("first_line"))
    judged = lines.join(firsts.join(removed.withColumn("gone", F.lit(True)), own, "left").where("gone or copies > 1"), own)
    out = judged.where((F.col("row") != F.col("first_row")) | (F.col("line") != F.col("first_line")) | F.coalesce("gone", F.lit(False)))
    per_row = out.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed"))  # lines of one document
    documents = table.where(F.col("line") == DOCUMENT).select("row", "doc_id", F.col("n").alias("n_lines"))
    return scratch.last(documents.join(per_row, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))))


def drop_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the later matches taken out of each text, columns unchanged; null texts stay null."""
    from .common import unused

    out = unused(docs, "lines_out")
    docs, own = numbered(docs, Scratch(docs.sparkSession, "lines"))
    columns = [c for c in docs.columns if c != own]
    removed = line_dedup(docs, similarity, row=own).select(F.col("row").alias(own + "_"), F.col("removed").alias(out)).where(F.size(out) > 0)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains(F.col(out), k)), "\n")
    joined = docs.join(removed, F.col(own) == F.col(own + "_"), "left")
    return joined.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(kept)).select(*columns)
