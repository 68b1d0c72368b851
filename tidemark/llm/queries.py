"""The subpackage's queries over the driver's tables, and their SQL."""

from pyspark.sql import functions as F

from . import ann, exact_dedup, licences, lines, mixing, near_dedup, packing, quality, toxicity, warc


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark, d):
    return ann.nearest(_table(spark, d, "embeddings"))


def op2_pack(spark, d):
    return packing.pack(_table(spark, d, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_dedup(spark, d):
    return lines.line_dedup(_table(spark, d, "documents")).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op4_near_dedup(spark, d):
    return near_dedup.near_dedup(_table(spark, d, "documents"), words=4)


def op5_warc(spark, d):
    archive = warc.write_archive(_table(spark, d, "pages"))
    return archive.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(_table(spark, d, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark, d):
    scored = toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op8_licences(spark, d):
    return licences.scan(licences.document_files(_table(spark, d, "documents"))).drop("row")


def op9_mix(spark, d):
    return mixing.mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark, d):
    return quality.quality(_table(spark, d, "documents"), _table(spark, d, "labels")).select("doc_id", F.round("log_weight", 6).alias("log_weight"), "n_ngrams", (F.col("sample_key") / 1e6).alias("sample_key"), "kept")


EXACT_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') body from documents),
r as (select *, first_value(doc_id) over w keep_id, count(*) over (partition by body) group_size, row_number() over w place from n window w as (partition by body order by chars desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) text_sha256 from r
"""

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_pack": op2_pack,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_licences": op8_licences,
    "op9_mix": op9_mix,
    "op10_quality": op10_quality,
}
SQL = {"op5_warc": warc.SQL, "op6_exact_dedup": EXACT_SQL, "op9_mix": mixing.SQL}
