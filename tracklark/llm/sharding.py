"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n gets the fractional rank (2r - 1) / 2n. All
rows in order of fractional rank are then a mixture in the sources' proportions wherever one cuts, and equal cuts give
shards whose row counts differ by one at most (law `rows`).

Scale: both ranks are places in an order over all rows, found by range partitions: rows are dealt to tasks by ranges of
the whole key, sorted there, and a small table of the ranges' sizes gives what comes before. The key ends with a number
of the row, so a source, an id or a text that holds a third of all rows spreads over many tasks, and rows without an id
as well. Only ids, sources, sizes and checksums are shuffled, never texts; they are written to the shared folder.

Nulls: rows of a null source form a source of their own; a null text has size 1 and checksum 0; rows with a null id
are shuffled like any other. Ties of the hash are broken by id, checksum and size, so repeated rows differ in nothing
but their slots. An empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators.tables import numbered
from tracklark.session import materialize, small_enough, table

#: Rows sorted by one task, about, and so many tasks at most.
BUCKET_ROWS, MOST_TASKS = 1 << 16, 1 << 15
#: Sources whose counts are broadcast; of more they are joined.
MOST_SENT = 10_000


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    spark = docs.sparkSession
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    keyed, _ = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
            mixed.alias("mixed"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    n = keyed.count()
    parts = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n / bucket_rows)))
    key = ("stratum", "mixed", "doc_id", "text_crc32", "size", "tie")
    ranked = numbered(keyed, *key, name="place", parts=parts)
    strata = ranked.groupBy("stratum").agg(F.count(F.lit(1)).alias("in_all"), F.min("place").alias("first"))
    if small_enough(strata, MOST_SENT):
        strata = F.broadcast(strata)
    part = (2 * (F.col("place") - F.col("first") + 1) - 1) / (2 * F.col("in_all"))
    placed = numbered(ranked.join(strata, "stratum").select(*key, part.alias("part")), "part", *key, name="place", parts=parts)
    at = F.col("place") - 1
    return (
        placed.withColumn("shard", F.expr(f"cast((place - 1) * {shards}L div {max(n, 1)}L as int)"))
        .select("doc_id", "size", "text_crc32", "shard", (at - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"))
    )


def op2_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards, with the law they keep."""
    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = r"""
WITH tbl AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce([CAST(k AS BIGINT)] || [CAST(x AS BIGINT) FOR x IN range(8)],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(k))
),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
    CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce([4294967295] || [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, tbl
),
p AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY mixed, doc_id NULLS FIRST, text_crc32, size) - 1)
    / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS part FROM d
),
g AS (
  SELECT *, row_number() OVER (ORDER BY part, stratum, mixed, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 8 // n AS INTEGER) AS shard,
  CAST(pos - (pos * 8 // n * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g
"""

QUERIES = {"op2_proportional_shards": op2_proportional_shards}
ORACLES = {"op2_proportional_shards": ORACLE}
