"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.crc32c import crc32c
from ..operators import reconcile, stats
from ..schema import from_events
from ..shared import new_path

BUFFER_BYTES = 4096


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hexed(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*[(F.hex(c) if dict(df.dtypes)[c] == "binary" else F.col(c)).alias(name) for name, c in columns.items()])


def scratch(spark: SparkSession) -> str:
    return new_path(spark, "tidemark")


def scan_full(spark, d):
    return hexed(reconcile.scan(log(spark, d)), k="user_key", v="value")


def scan_range(spark, d):
    return hexed(reconcile.scan(log(spark, d), b"3", b"6"), k="user_key", v="value")


def get_newest(spark, d):
    return hexed(reconcile.newest_per_key(log(spark, d)), k="user_key", seq="sequence", typ="value_type", v="value").withColumn("typ", F.col("typ").cast("int"))


def get_point(spark, d):
    return hexed(reconcile.get(log(spark, d), b"7"), k="user_key", v="value")


def multi_get(spark, d):
    probes = spark.read.parquet(f"{d}/customer.parquet").select(F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("user_key"))
    return hexed(reconcile.multi_get(log(spark, d), probes), k="user_key", v="value")


def prefix_scan(spark, d):
    return hexed(reconcile.live_view(log(spark, d).where(reconcile.has_prefix(b"1"))), k="user_key", v="value")


def tombstones(spark, d):
    return hexed(reconcile.tombstones(log(spark, d)), k="user_key", seq="sequence")


def snapshot(spark, d):
    return hexed(reconcile.live_view(reconcile.as_of(log(spark, d), 5000)), k="user_key", v="value")


def merge_sources(spark, d):
    m = log(spark, d)
    s = F.col("sequence")
    merged = reconcile.merge_sources(m.where(s > 8000), m.where((s > 4000) & (s <= 8000)), m.where(s <= 4000))
    live = reconcile.first_source(merged).where("value_type = 1")
    return live.groupBy(F.col("source_rank").alias("source")).agg(F.count("*").alias("n"))


def ceiling(spark, d):
    m = log(spark, d)
    ids = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") * 7 % 200).alias("p")).distinct()
    found = reconcile.ceiling(m, ids.select(F.encode(F.col("p").cast("string"), "UTF-8").alias("user_key")))
    return hexed(found, p="probe", k="ceiling")


def internal_order(spark, d):
    from ..operators.sequence import with_index

    ordered = with_index(log(spark, d), ["user_key", F.desc("sequence"), F.desc("value_type")], "pos", 1)
    return hexed(ordered, pos="pos", k="user_key", seq="sequence")


def internal_key(spark, d):
    m = log(spark, d)
    return m.select(F.col("sequence").alias("seq"), F.hex(keys.encode_column(F.col("user_key"), F.col("sequence"), F.col("value_type"))).alias("ik"))


def internal_key_roundtrip(spark, d):
    ik = log(spark, d).select(keys.encode_column(F.col("user_key"), F.col("sequence"), F.col("value_type")).alias("ik"))
    k, seq, typ = keys.decode_columns(F.col("ik"))
    return ik.select(F.hex(k).alias("k"), seq.alias("seq"), typ.cast("int").alias("typ"))


def varint_size(spark, d):
    return log(spark, d).select(F.col("sequence").alias("seq"), keys.varint_size_column(F.col("sequence")).alias("n"))


def prefix_share(spark, d):
    return stats.prefix_share(log(spark, d)).groupBy("shared").agg(F.count("*").alias("n"))


def max_sequence(spark, d):
    return stats.max_sequence(log(spark, d))


def size_accounting(spark, d):
    return stats.physical_bytes(log(spark, d))


def space_amplification(spark, d):
    return stats.space_amplification(log(spark, d)).select("physical_bytes", "live_bytes")


def flush_generations(spark, d):
    g = stats.flush_generations(log(spark, d), BUFFER_BYTES, rows_per_chunk=1 << 16)
    return g.groupBy("generation").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def replay(spark, d):
    from ..sources.datasource import register, write_wal

    path = scratch(spark)
    write_wal(log(spark, d), path)
    register(spark)
    back = spark.read.format("tidemark_wal").load(path)
    return hexed(back, k="user_key", seq="sequence", typ="value_type", v="value").withColumn("typ", F.col("typ").cast("int"))


def sorted_table(spark, d):
    from ..sources.datasource import register, write_sst

    path = scratch(spark)
    write_sst(log(spark, d), path)
    register(spark)
    return hexed(reconcile.scan(spark.read.format("tidemark_sst").load(path), b"3", b"6"), k="user_key", v="value")


def store_batches(spark, d):
    from ..operators.store import Store

    m = log(spark, d)
    with Store.open(spark, scratch(spark)) as store:
        for low, high in ((0, 4000), (4000, 8000), (8000, None)):
            part = m.where(F.col("sequence") > low)
            store.write_batch(part if high is None else part.where(F.col("sequence") <= high), ["sequence"])
        store.compact()
        return hexed(store.scan(), k="user_key", v="value")


def engine_metrics(spark, d):
    return stats.engine_metrics(log(spark, d), BUFFER_BYTES)


def crc32c_values(spark, d):
    return log(spark, d).select(F.col("sequence").alias("seq"), crc32c("value").alias("crc"))


M = """m as (select encode(cast(user_id as varchar)) k, event_id + 1 seq, case when event_type = 'error' then 0 else 1 end typ,
 case when event_type = 'error' then encode('') else encode(props) end v from events)"""
NEWEST = "newest as (select * from (select *, row_number() over (partition by k order by seq desc) rn from m) where rn = 1)"
GENERATIONS = f"""x as (select seq, octet_length(k) + 8 + octet_length(v) sz from m),
 g as (select seq, 0 gen, case when sz >= {BUFFER_BYTES} then 0 else sz end acc, sz from x where seq = 1
 union all select x.seq, g.gen + case when g.acc = 0 then 1 else 0 end, case when g.acc + x.sz >= {BUFFER_BYTES} then 0 else g.acc + x.sz end, x.sz
 from g join x on x.seq = g.seq + 1)"""
TRAILER = " || ".join(f"printf('%02X', ((((seq::BIGINT) << 8) | typ) >> {8 * i}) & 255)" for i in range(8))

SQL = {
    "scan_full": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1",
    "scan_range": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1 and k >= '3'::blob and k < '6'::blob",
    "get_newest": f"with {M}, {NEWEST} select hex(k) k, seq, typ, hex(v) v from newest",
    "get_point": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1 and k = '7'::blob",
    "multi_get": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1 and k in (select encode(cast(c_custkey as varchar)) from customer)",
    "prefix_scan": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1 and k >= '1'::blob and k < '2'::blob",
    "tombstones": f"with {M}, {NEWEST} select hex(k) k, seq from newest where typ = 0",
    "snapshot": f"with {M}, s as (select *, row_number() over (partition by k order by seq desc) rn from m where seq <= 5000) select hex(k) k, hex(v) v from s where rn = 1 and typ = 1",
    "merge_sources": f"""with {M}, s as (select *, case when seq > 8000 then 0 when seq > 4000 then 1 else 2 end src from m),
 f as (select *, row_number() over (partition by k order by src, seq desc) rn from s) select src as source, count(*) n from f where rn = 1 and typ = 1 group by src""",
    "ceiling": f"""with {M}, p as (select distinct encode(cast(user_id * 7 % 200 as varchar)) p from events)
 select hex(p) p, hex(min(k)) k from p left join (select distinct k from m) on k >= p group by p""",
    "internal_order": f"with {M} select row_number() over (order by k, seq desc, typ desc) pos, hex(k) k, seq from m",
    "internal_key": f"with {M} select seq, hex(k) || {TRAILER} ik from m",
    "internal_key_roundtrip": f"with {M} select hex(k) k, seq, typ from m",
    "varint_size": f"with {M} select seq, cast(greatest(1, ceil(length(bin(seq)) / 7.0)) as integer) n from m",
    "prefix_share": f"""with {M}, o as (select decode(k) k, lag(decode(k)) over (order by k, seq desc, typ desc) b from m),
 l as (select case when k = b then length(k) else coalesce(list_min(list_filter(range(1, least(length(k), length(b)) + 1), lambda i: substr(k, i, 1) <> substr(b, i, 1))) - 1, least(length(k), length(b))) end shared from o where b is not null)
 select cast(shared as integer) shared, count(*) n from l group by 1""",
    "max_sequence": f"with {M} select max(seq) max_sequence, count(*) n from m",
    "size_accounting": f"with {M} select cast(sum(octet_length(k) + 8 + octet_length(v)) as bigint) physical_bytes from m",
    "space_amplification": f"with {M}, {NEWEST} select cast((select sum(octet_length(k) + 8 + octet_length(v)) from m) as bigint) physical_bytes, cast((select sum(octet_length(k) + octet_length(v)) from newest where typ = 1) as bigint) live_bytes",
    "flush_generations": f"with recursive {M}, {GENERATIONS} select cast(gen as bigint) generation, count(*) n, cast(sum(sz) as bigint) bytes from g group by gen",
    "replay": f"with {M} select hex(k) k, seq, typ, hex(v) v from m",
    "sorted_table": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1 and k >= '3'::blob and k < '6'::blob",
    "store_batches": f"with {M}, {NEWEST} select hex(k) k, hex(v) v from newest where typ = 1",
    "engine_metrics": f"""with recursive {M}, {GENERATIONS}, f as (select gen, count(*) n, sum(sz) b from g group by gen)
 select cast(sum(n) as bigint) wal_append_count, cast(sum(n) as bigint) wal_sync_count, cast(count(*) filter (b >= {BUFFER_BYTES}) as bigint) memtable_switch_count,
 cast(count(*) filter (b >= {BUFFER_BYTES}) as bigint) flush_count, cast(coalesce(sum(b) filter (b >= {BUFFER_BYTES}), 0) as bigint) flush_bytes, cast(coalesce(sum(b) filter (b < {BUFFER_BYTES}), 0) as bigint) memtable_size_bytes from f""",
}

QUERIES = {name: globals()[name] for name in SQL} | {"crc32c": crc32c_values}

#: Byte by byte, with a table of what eight steps of the reflected Castagnoli polynomial make of each byte.
SQL["crc32c"] = f"""with {M}, t as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, case when c & 1 = 1 then 2197175160 else 0 end)) order by n) tab
 from (select unnest(range(256)) n)),
 b as (select seq, list_transform(range(octet_length(v)), lambda i: ('0x' || substr(hex(v), cast(2 * i + 1 as integer), 2))::bigint) bytes from m)
 select seq, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::bigint) crc from b, t"""
