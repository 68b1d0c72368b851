"""Approximate nearest neighbours by collision counting (operator 1).

Largest inner product becomes smallest distance by one added coordinate that gives all vectors of a block the block's
largest norm; the query is scaled to it too, which leaves its order as it is.
Each projection on a random line is a sorted array. A query's window on each line is centred on the query's own
projection and widens step by step (virtual rehashing); a vector that lies in the windows of enough lines at once
is verified by its exact inner product. Widening ends once enough vectors were verified.

The index is parted into bands of like norms, so that the added coordinate stays small, and a band is dealt into blocks
of a bounded size by a hash; neighbouring bands of few rows share a block that is verified whole. The query set is dealt
into chunks. Each pair of block and chunk is a task's row; the best of all blocks are merged per query.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mapped

NEIGHBOURS = 20
LINES = 64
BLOCK_ROWS = 8192
CHUNK_ROWS = 1024
#: Share of the lines on which a vector has to collide with the query.
COLLISIONS = 0.8
#: Half the first window, in standard deviations of a line's values, and the factor of each widening.
FIRST_WINDOW = 0.8 * 1.12**7
WIDEN = 1.12
#: Vectors verified per block before widening ends, besides the neighbours asked for: share of the block.
VERIFIED = 0.25
LEAST_VERIFIED = 400
#: Largest over smallest norm of a band; unit vectors lie in the middle of one.
BAND = 1.1
SEED = 20240229


def lines(dimension: int, n: int = LINES) -> np.ndarray:
    """Directions, alike for the same dimension; the last row belongs to the added coordinate."""
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension + 1, n))


def _valid(column) -> tuple[np.ndarray, np.ndarray | None]:
    """Which vectors of a list column take part, and those as a matrix; one dimension a table."""
    rows = [None if v is None or None in v else np.array(v, float) for v in column.to_pylist()]
    ok = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in rows], bool)
    return ok, [v for v, k in zip(rows, ok, strict=True) if k]


def _packed(batch: pa.RecordBatch) -> dict:
    ok, rows = _valid(batch.column("embedding"))
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[ok]
    return {"own": batch.column("own").to_numpy()[ok], "vec_id": ids, "dimension": [len(v) for v in rows], "band": [band(v) for v in rows], "vector": [v.tobytes() for v in rows]}


def band(v: np.ndarray) -> int:
    """Number of the band of norms that a vector lies in."""
    norm = np.clip(np.sqrt((v * v).sum()), 1e-300, 1e300)
    return int(np.floor(np.log(norm) / np.log(BAND) + 0.5))


def planned(sizes: list[tuple[int, int, int]], block_rows: int) -> list[tuple[int, int, int, int]]:
    """(dimension, band, first block, blocks) for (dimension, band, rows); blocks are numbered from 0 in each dimension."""
    groups: list[list] = []  # dimension, rows, bands
    for dimension, b, n in sorted(sizes, key=lambda s: (s[0], -s[1])):
        if groups and groups[-1][0] == dimension and groups[-1][1] + n <= min(LEAST_VERIFIED, block_rows):
            groups[-1][1] += n
            groups[-1][2].append(b)
        else:
            groups.append([dimension, n, [b]])
    out, used = [], {}
    for dimension, n, bands in groups:
        blocks, first = -(-n // block_rows), used.get(dimension, 0)
        out += [(dimension, b, first, blocks) for b in bands]
        used[dimension] = first + blocks
    return out


def index_block(ids: np.ndarray, x: np.ndarray):
    """ids and vectors in the order of ids, and on each line the vectors' order and sorted projections."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    squares = (x * x).sum(axis=1)
    added = np.sqrt(np.maximum(0, squares.max() - squares))
    directions = lines(x.shape[1])
    y = (x @ directions[:-1] + added[:, None] * directions[-1]).T  # line by line
    by = np.argsort(y, axis=1, kind="stable").astype(np.int32)
    return ids, x, by, np.take_along_axis(y, by, axis=1)


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    dimension = key[1].as_py()
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), float).reshape(-1, dimension)
    ids, x, by, y = index_block(table.column("vec_id").to_numpy(), x)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dimension": pa.array([dimension], pa.int32()), "ids": [ids.tobytes()], "vectors": [x.tobytes()], "order": [by.tobytes()], "values": [y.tobytes()]})


def search_block(ids, x, order, values, query_ids, q, k: int = NEIGHBOURS):
    """(query position, vec_id, score) of the best found in one block for each query, its own row left out."""
    n, m = len(ids), len(order)
    need = max(1, int(np.ceil(COLLISIONS * m)))
    enough = min(n, k + 1 + max(LEAST_VERIFIED, int(VERIFIED * n)))
    norms = np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300)
    at = (q * (np.sqrt((x * x).sum(axis=1).max()) / norms)[:, None]) @ lines(x.shape[1], m)[:-1]
    # Equal values have no deviation, so a window also grows with what the line's values and queries measure.
    spread = values.std(axis=1) + 1e-3 * np.maximum(np.abs(values).max(axis=1), np.abs(at).max(axis=0)) + 1e-300
    places = np.empty((m, n), np.uint16 if n < 1 << 16 else np.uint32)
    np.put_along_axis(places, order, np.arange(n, dtype=places.dtype)[None], axis=1)
    counts: list = [None] * len(q)
    found: list = [None] * len(q)
    waiting, half, before, steps = np.arange(len(q)), FIRST_WINDOW, None, 0
    while len(waiting):
        windows = np.empty((2, m, len(q)), np.int64)
        for j in range(m):
            windows[0, j, waiting] = np.searchsorted(values[j], at[waiting, j] - half * spread[j], "left")
            windows[1, j, waiting] = np.searchsorted(values[j], at[waiting, j] + half * spread[j], "right")
        left = []
        for i in waiting:
            low, high = windows[0, :, i].tolist(), windows[1, :, i].tolist()
            if before is None:
                # A vector lies in a window if its place in the sorted line does; one unsigned comparison tells.
                begin, width = (windows[0, :, i, None]).astype(places.dtype), (windows[1, :, i] - windows[0, :, i])[:, None]
                counts[i] = ((places - begin) < width.astype(places.dtype)).sum(axis=0, dtype=np.uint16).astype(np.int64)
            else:  # a wider window adds its two margins
                old_low, old_high = before[0, :, i].tolist(), before[1, :, i].tolist()
                rims = [order[j, low[j] : old_low[j]] for j in range(m)] + [order[j, old_high[j] : high[j]] for j in range(m)]
                counts[i] += np.bincount(np.concatenate(rims), minlength=n)
            found[i] = np.flatnonzero(counts[i] >= need)
            if len(found[i]) < enough and any(a > 0 or b < n for a, b in zip(low, high, strict=True)):
                left.append(i)
            else:
                counts[i] = None
        steps += 1
        waiting, half, before = np.array(left, np.int64), half * (WIDEN if steps < 20 else 2), windows
    out = []
    for i, own in enumerate(found):
        own = own[ids[own] != query_ids[i]]
        scores = (x[own] * q[i]).sum(axis=1)
        best = np.lexsort((ids[own], -scores))[:k]
        out.append((ids[own][best], scores[best]))
    return out


def _search(k: int):
    def make():
        held: dict = {}

        def run(batch: pa.RecordBatch) -> dict:
            out = {"own": [], "query_id": [], "vec_id": [], "score": []}
            for r in batch.to_pylist():
                d = r["dimension"]
                key = (r["block"], d)
                if key not in held:
                    held.clear()
                    ids = np.frombuffer(r["ids"], np.int64)
                    held[key] = ids, np.frombuffer(r["vectors"], float).reshape(len(ids), d), np.frombuffer(r["order"], np.int32).reshape(-1, len(ids)).astype(np.intp), np.frombuffer(r["values"], float).reshape(-1, len(ids))
                query_ids, q = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["queries"], float).reshape(-1, d)
                owns = np.frombuffer(r["query_rows"], np.int64)
                for own, query_id, (ids, scores) in zip(owns, query_ids, search_block(*held[key], query_ids, q, k), strict=True):
                    out["own"] += [own] * len(ids)
                    out["query_id"] += [query_id] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += scores.tolist()
            return out

        return run

    return make


def _chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table({"dimension": pa.array([key[1].as_py()], pa.int32()), **{to: [table.column(c).to_numpy().astype(np.int64).tobytes()] for to, c in (("query_rows", "own"), ("query_ids", "vec_id"))}, "queries": [b"".join(table.column("vector").to_pylist())]})


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``vectors`` (vec_id, embedding) for each query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but those with the query's vec_id.
    Score is the inner product in double precision; ties go to the smaller vec_id. Rows with a null vec_id, and vectors that
    are null, empty, zero or hold null or non-finite components take no part; only vectors of one length are compared.
    Rows that share a vec_id are candidates each, and queries each, with a list of their own. A query without candidates has no rows, as has an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("own"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    packed = scratch.keep(mapped(rows, "own long, vec_id long, dimension int, band int, vector binary", lambda: _packed), "packed")
    sizes = [tuple(r) for r in packed.groupBy("dimension", "band").count().collect()]  # at most some 15,000 bands a dimension
    n = sum(s[2] for s in sizes)
    plan = spark.createDataFrame(planned(sizes, block_rows), "dimension int, band int, first int, blocks int")
    dealt = packed.join(F.broadcast(plan), ["dimension", "band"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks"))).cast("long"))
    index = dealt.groupBy("block", "dimension").applyInArrow(_block, "block long, dimension int, ids binary, vectors binary, order binary, values binary")
    index = scratch.keep(index, "index")
    queries = packed.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-n // every // chunk_rows))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("long"))
    asked = asked.groupBy("chunk", "dimension").applyInArrow(_chunk, "dimension int, query_rows binary, query_ids binary, queries binary")
    numbers = plan.groupBy("dimension").agg(F.max(F.col("first") + F.col("blocks")).cast("long").alias("all"))
    asked = asked.join(F.broadcast(numbers), "dimension").select("dimension", "query_rows", "query_ids", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("block"))
    asked = scratch.keep(asked, "asked")
    pairs = index.join(asked, ["block", "dimension"]).repartition("block", "query_ids")
    found = scratch.keep(mapped(pairs, "own long, query_id long, vec_id long, score double", _search(k)), "found")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return scratch.last(out)
