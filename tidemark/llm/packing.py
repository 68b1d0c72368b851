"""Best-fit packing of token sequences by a grouping genetic algorithm on islands (operator 2).

Documents become pieces: only those longer than a sequence are cut, into full sequences and one shorter first
piece, so that only one piece a document needs packing. A hash deals these to shards of a bounded size. Each
shard is evolved on several islands: a crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold duplicates, and best-fits the displaced pieces, longest first. Elites move round the ring of a
shard's islands between epochs. The emptiest bins of all shards are then packed again in fewer shards, until one is left.
"""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped

CAPACITY = 2048
SHARD_ITEMS = 2048
ISLANDS = 3
EPOCHS = 2
POPULATION = 5
CHILDREN = 12
#: Bins of a shard that are packed again with those of other shards.
REPACKED_BINS = 32

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def make():
        from pyspark import TaskContext

        from .tokens import tokens

        encode, place, count = tokens(path), TaskContext.get().partitionId() << 40, 0

        def run(batch: pa.RecordBatch) -> dict:
            nonlocal count
            out = {c.split(" ")[0]: [] for c in PIECES.split(", ")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (encode(text) if text else b"") + bytes(4)
                n = len(data) // 4
                first = n if n <= capacity else n % capacity or capacity
                start = 0
                for piece, end in enumerate(range(first, n + 1, capacity)):
                    for c, v in zip(out.values(), (place + count, doc_id, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])), strict=True):
                        c.append(v)
                    start, count = end, count + 1
            return out

        return run

    return make


class Bins:
    """Bins with best fit in constant time: bins by the room they have left, and a bit set of rooms in use."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0

    def _offer(self, b: int) -> None:
        r = self.room[b]
        if r:
            at = self.by_room.get(r)
            if at:
                at.append(b)
            else:
                self.by_room[r] = [b]
                self.rooms |= 1 << r

    def open(self, items: list[int], size: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - size)
        self._offer(len(self.items) - 1)

    def put(self, item: int, size: int) -> None:
        fitting = self.rooms >> size
        if not fitting:
            self.open([item], size)
            return
        r = size + (fitting & -fitting).bit_length() - 1
        at = self.by_room[r]
        b = at.pop()
        if not at:
            self.rooms &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - size
        self._offer(b)

    def fitness(self) -> tuple:
        """Fewer bins first, then the sum of squared fills."""
        return -len(self.items), sum((self.capacity - r) ** 2 for r in self.room)


def best_fit(sizes: list[int], order: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins


def crossover(a: Bins, b: Bins, sizes: list[int], rnd: random.Random) -> Bins:
    """Some of b's best-filled bins whole, the bins of a without any of their items, the displaced items by best fit."""
    full = sorted(range(len(b.items)), key=b.room.__getitem__)
    full = full[: max(1, int(len(full) * rnd.uniform(0.3, 0.8)))]
    chosen = [k for k in full if rnd.random() < 0.6] or full[:1]
    child, taken = Bins(b.capacity), set()
    for k in chosen:
        child.open(list(b.items[k]), b.capacity - b.room[k])
        taken.update(b.items[k])
    displaced = []
    worst = max(a.room, default=0)
    for items, room in zip(a.items, a.room, strict=True):
        # A bin of a is dissolved if it holds a duplicate; mutation also dissolves one of its emptiest now and then.
        if not taken.isdisjoint(items) or room == worst and room and rnd.random() < 0.5:
            displaced += [i for i in items if i not in taken]
        else:
            child.open(list(items), a.capacity - room)
    displaced.sort(key=lambda i: -sizes[i] + rnd.random() * 2)
    for i in displaced:
        child.put(i, sizes[i])
    return child


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], rnd: random.Random, children: int = CHILDREN) -> list[Bins]:
    """A population from elites that came, or from best fit in several orders; best first. Ends at the lower bound."""
    bound = -(-sum(sizes) // capacity)
    population = []
    for groups in seeds:
        bins = Bins(capacity)
        for g in groups:
            bins.open(list(g), sum(sizes[i] for i in g))
        population.append(bins)
    if not population:
        falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        population.append(best_fit(sizes, falling, capacity))
    rank = lambda x: x.fitness()
    if len(max(population, key=rank).items) > bound:
        while len(population) < POPULATION:
            noise = rnd.uniform(0.02, 0.3)
            population.append(best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rnd.random())), capacity))
        for _ in range(children):
            population.sort(key=rank, reverse=True)
            if len(population[0].items) <= bound:
                break
            a, b = rnd.sample(population[: max(3, POPULATION // 2 + 1)], 2)
            child = crossover(a, b, sizes, rnd)
            if rank(child) > rank(population[-1]):
                population[-1] = child
    return sorted(population, key=rank, reverse=True)


STATE = "shard long, island int, uids array<long>, sizes array<int>, n_bins int, squares long, elite array<int>"


def _groups(elite) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(elite):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _epoch(capacity: int, epoch: int):
    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = {c.split(" ")[0]: [] for c in STATE.split(", ")}
            cols = [batch.column(c).to_pylist() for c in ("shard", "island", "uids", "sizes", "elite", "visitor")]
            for shard, island, uids, sizes, elite, visitor in zip(*cols, strict=True):
                rnd = random.Random(shard * 1009 + island * 31 + epoch)
                seeds = [_groups(e) for e in (elite, visitor) if e is not None]
                best = evolve(sizes, capacity, seeds, rnd)[0]
                placed = np.empty(len(sizes), np.int32)
                for b, items in enumerate(best.items):
                    placed[items] = b
                count, squares = best.fitness()
                for c, v in zip(out.values(), (shard, island, uids, sizes, -count, squares, placed), strict=True):
                    c.append(v)
            return out

        return run

    return make


def _places(capacity: int, repacked: int):
    """uid, bin (the uid that names it), offset, open: whether the bin is to be packed again."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = {"uid": [], "size": [], "bin": [], "offset": [], "open": []}
            for uids, sizes, elite in zip(*(batch.column(c).to_pylist() for c in ("uids", "sizes", "elite")), strict=True):
                bins = sorted(_groups(elite), key=lambda g: sum(sizes[i] for i in g))
                again = min(repacked, max(1, len(bins) // 8))
                for k, items in enumerate(bins):
                    at = 0
                    for i in items:
                        for c, v in zip(out.values(), (uids[i], sizes[i], uids[items[0]], at, k < again), strict=True):
                            c.append(v)
                        at += sizes[i]
            return out

        return run

    return make


def assign(items: DataFrame, capacity: int, scratch: Scratch, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, size) of less than a full sequence."""
    done, level, before = None, 0, None
    while True:
        n = items.count()
        shards = max(1, -(-n // shard_items))
        dealt = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("uid", "size"))).alias("items"))
        state = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.uid").alias("uids"), F.col("items.size").cast("array<int>").alias("sizes"))
        none = F.lit(None).cast("array<int>")
        state = state.withColumns({"elite": none, "visitor": none}).repartition("shard", "island")
        for epoch in range(EPOCHS):
            evolved = scratch.keep(mapped(state, STATE, _epoch(capacity, epoch)), f"level-{level}-epoch-{epoch}")
            guests = evolved.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elite").alias("visitor"))
            state = evolved.join(guests, ["shard", "island"])
        best = evolved.groupBy("shard").agg(F.max_by(F.struct("uids", "sizes", "elite"), F.struct(-F.col("n_bins"), "squares", "island")).alias("best")).select("best.*")
        # Where hardly any bin is worth another round, as with a shard that fits one bin, this round is the last.
        last = shards == 1 or before is not None and 2 * n > before
        placed = scratch.keep(mapped(best, "uid long, size long, bin long, offset long, open boolean", _places(capacity, 0 if last else REPACKED_BINS)), f"level-{level}")
        final = placed.where(~F.col("open")).select("uid", F.col("bin").alias("sequence_id"), "offset")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        items, level = placed.where("open").select("uid", "size"), level + 1
        before = n


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a vocabulary file on every executor. A document's ids end with id 0; null and
    empty texts have only that. A sequence is named by the uid of one of its pieces, and its offsets leave no gap.
    Null doc_ids stay null, and repeated rows are packed each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.keep(mapped(rows, PIECES, _pieces(tokenizer, capacity)), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    placed = assign(part.select("uid", F.col("length").alias("size")), capacity, scratch, shard_items)
    return full.unionByName(part.join(placed, "uid").select(*full.columns))
