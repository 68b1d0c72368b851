"""Mixing sources to target weights by a low-discrepancy schedule (operator 9). DataFrame functions only.

The documents of a source, shuffled by a hash, are a circular stream of words that is cut into blocks of equal
length. Slot n of the schedule goes to the source whose part of the cumulative weights holds the n-th golden
ratio point; the r-th slot of a source takes block r of its stream. Prefixes of the schedule of any length
keep the weights to within a few blocks. Slots beyond a source's target are left out, and those it lacks at the
end, a few at most, follow the others, so that a source gives its target to the word.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, unused

# Source weights in turn, the share of all words that the mix takes, most words of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 64
POINT_BITS = 40
#: The golden ratio's conjugate as a fraction of 2 ** 40; odd, so that its multiples meet every point once.
GOLDEN = round((5**0.5 - 1) / 2 * (1 << POINT_BITS)) | 1
ROWS_PER_BUCKET = 4096
SLOTS_PER_CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs of characters outside ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table with one row a source.

    Water filling: with the sources in the order of size by weight, the level is found from running sums of
    what is capped before and the weights from there on. Windows here run over the sources only.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("wanted", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    level = (F.col("wanted") - F.col("capped_before")) / F.col("weights_from")
    # The first source in the order that its cap doesn't bind sets the level.
    s = s.withColumn("level", F.when(F.col("weight") * level <= F.col("cap"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def streams(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (row, doc_id, source, size) with ``start``, the words before it in its source's shuffled stream.

    Order: MD5 of doc_id, doc_id, size. A source's running sum is made of sums over buckets of the hash and
    running sums inside a bucket, so that one source may hold any share of the rows.
    """
    n = rows.count()
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < n:
        digits += 1
    # Rows without an identifier can't be told apart by it; their size and row spread them.
    hashed = rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("row").cast("string"))).cast("binary")))
    hashed = hashed.withColumn("bucket", F.substring("hash", 1, digits))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = [placed[c].eqNullSafe(offsets[c]) for c in ("source", "bucket")]
    return placed.join(offsets, same[0] & same[1]).select("row", placed["doc_id"], placed["source"], "size", (F.col("offset") + F.col("inside")).alias("start"))


def schedule(goals: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """slot, source_no, rank: which source's which block comes when, for goals (source_no, goal words).

    Points go to sources by an equi-join on cells of the unit interval, never by comparing each point with each source.
    """
    spark = goals.sparkSession
    goals = goals.where("goal > 0").withColumn("need", F.ceil(F.col("goal") / block))
    total = goals.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    slots, sources = int(total[0]), int(total[1])
    one, cells_log = 1 << POINT_BITS, max(8, min(24, (2 * sources).bit_length()))
    width = one >> cells_log
    run = Window.orderBy("source_no")
    edges = goals.withColumn("high", F.sum("need").over(run)).withColumn("low", F.col("high") - F.col("need"))
    scale = lambda c: F.floor(c / max(1, slots) * one).cast("long")
    edges = edges.select("source_no", "need", scale(F.col("low")).alias("low"), scale(F.col("high")).alias("high")).where("low < high")
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    # id * GOLDEN modulo 2 ** 40 in two parts, neither of which overflows a long.
    low, high = F.pmod("id", F.lit(1 << 20)) * GOLDEN, F.shiftright("id", 20) * ((GOLDEN << 20) % one)
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(low + F.pmod(high, F.lit(one)), F.lit(one)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    hits = points.join(cells, "cell").where("point >= low and point < high").select("slot", "source_no", "need", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    hits = scratch.keep(hits, "hits")
    counts = hits.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")))
    main = ranked.join(offsets, ["source_no", "chunk"]).select("slot", "source_no", (F.col("offset") + F.col("place") - 1).alias("rank"), "need").where("rank < need").drop("need")
    had = goals.join(hits.groupBy("source_no").agg(F.count("*").alias("n")), "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = had.where("n < need").select("source_no", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank"))
    return main.unionByName(late.select((F.col("rank") + slots).alias("slot"), "source_no", "rank"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, most: float = MOST, row: str | None = None) -> DataFrame:
    """row, doc_id, size, source, source_size, target, taken, first_take, second_take, first_slot for each row of ``docs``.

    ``taken`` counts the words that the scheduled blocks take of the document, repeats counted; first_take and
    second_take are those of the stream's first and second round, each from the document's first word on. ``first_slot``
    is the first slot of the schedule that takes of it, null if none does: in its order every prefix keeps the weights.
    Sources are taken in code point order with null last; null texts have no words; null doc_ids are told apart
    by row, the column that ``row`` names and that has to be written, or else a row id of this one scan; rows that share a doc_id count each. An empty
    table gives no rows, and a source without words a target of 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    rows = scratch.keep(sized, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, share, most)
    numbers = aims.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("goal", F.floor("target"))
    numbers = scratch.keep(numbers, "targets")
    placed = streams(rows, scratch)
    placed = placed.join(numbers, placed["source"].eqNullSafe(numbers["source"])).select("row", "doc_id", placed["source"], "size", "start", "source_size", "target", "source_no", "goal")
    placed = scratch.keep(placed, "placed")
    # Where a document lies in the first and second round of the stream, cut at block edges.
    rounds = F.array(F.struct(F.lit(1).alias("round"), F.col("start").alias("from")), F.struct(F.lit(2).alias("round"), (F.col("start") + F.col("source_size")).alias("from")))
    laid = placed.where("size > 0").select("row", "source_no", "size", "goal", F.explode(rounds).alias("r")).select("row", "source_no", "size", "goal", "r.*").where("from < goal")
    cut = F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.least(F.col("from") + F.col("size"), F.col("goal")) - 1) / block)))
    parts = laid.withColumn("rank", cut)
    low = F.greatest(F.col("from"), F.col("rank") * block)
    high = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * block, F.col("goal"))
    parts = parts.select("row", "source_no", "rank", "round", (high - low).alias("words"))
    plan = schedule(numbers.select("source_no", "goal"), block, scratch)
    got = parts.join(plan, ["source_no", "rank"]).groupBy("row").agg(
        F.sum("words").alias("taken"),
        F.sum(F.when(F.col("round") == 1, F.col("words")).otherwise(0)).alias("first_take"),
        F.sum(F.when(F.col("round") == 2, F.col("words")).otherwise(0)).alias("second_take"),
        F.min("slot").alias("first_slot"),
    )
    none = F.lit(0).cast("long")
    out = placed.join(got, "row", "left").select(
        "row", "doc_id", "size", "source", "source_size", "target", *[F.coalesce(c, none).alias(c) for c in ("taken", "first_take", "second_take")], "first_slot"
    )
    return scratch.last(out)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, columns unchanged: a row for each round that takes words of a document.

    A document taken whole keeps its text; one that a target cuts off keeps its first words, joined by blanks.
    """
    size, take, of = (unused(docs, name) for name in ("mix_size", "mix_take", "mix_of"))
    columns = docs.columns
    docs, own = numbered(docs, Scratch(docs.sparkSession, "mix"))
    taken = mix(docs, row=own).where("taken > 0").select(F.col("row").alias(of), F.col("size").alias(size), F.explode(F.array("first_take", "second_take")).alias(take)).where(F.col(take) > 0)
    words = F.expr(rf"array_join(slice(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), 1, cast({take} as int)), ' ')")
    out = docs.join(taken, F.col(own) == F.col(of)).withColumn("text", F.when(F.col(take) < F.col(size), words).otherwise(F.col("text")))
    return out.select(*columns)


SQL = r"""
with recursive d as (select doc_id, source, cast(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) no from d group by source),
w as (select *, cast([3, 1, 2][1 + (no - 1) % 3] as double) weight, source_size * 2.0::double cap, (select sum(source_size) from s) * 1.5::double wanted from s),
l as (select *, (wanted - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
 / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) lvl, cap / weight ratio from w),
f as (select min_by(lvl, ratio) lvl from l where weight * lvl <= cap),
t as (select l.source, l.source_size, coalesce(least(cap, weight * f.lvl), cap) target from l left join f on true),
p as (select doc_id, d.source, size, source_size, target, coalesce(sum(size) over (partition by d.source order by md5(cast(doc_id as varchar)), doc_id, size rows between unbounded preceding and 1 preceding), 0) start
 from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start)) as bigint) taken from p
"""
