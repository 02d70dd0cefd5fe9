"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split further."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, discard, running_start, table, unused

BITS, STRIDE = 60, 15


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, page, shard, shard_bytes, and the column `carry` where named.

    The hash is the first 60 bits of md5(key as text; null: ''). A document's shard is the shallowest hash prefix whose
    documents hold `limit` bytes or fewer, or a single document. Directory levels are summed from at most 2**15 cells a
    stride, so no text and no key is ever gathered in one place; each further stride reads only rows still oversized.
    Rows that agree in all 60 bits (one key repeated) cannot split: they go to numbered overflow pages of the bucket,
    each within the limit. Null text has 0 bytes; an empty table gives no rows; columns other than key and text are ignored.
    """
    spark = docs.sparkSession
    own = [carry] if carry else []
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *own)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()), "shard-rows")
    done: list[DataFrame] = []
    for low in range(0, BITS, STRIDE):
        high = low + STRIDE
        cell = F.shiftright("h", BITS - high)
        cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        levels = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n")).filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1))
        leaf = levels.drop("b", "n").join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        placed = cut(rows.withColumn("cell", cell).join(leaf, "cell", "left").drop("cell"), f"shard-stride{low}")
        done.append(placed.filter("leaf is not null").select("doc_id", "n_bytes", *own, "leaf.*", F.lit(0).cast("long").alias("page")))
        rows = placed.filter("leaf is null").drop("leaf")
        if rows.isEmpty():
            break
    else:
        most = rows.groupBy("h").agg(F.max("n_bytes").alias("most"))
        paged = running_start(rows, "h", "_part", [F.col(c) for c in ("n_bytes", *own)], "n_bytes", "at").join(most, "h")
        paged = paged.withColumn("page", F.expr(f"at div greatest({limit} - most, 1)"))
        sizes = paged.groupBy("h", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
        done.append(paged.join(sizes, ["h", "page"]).select("doc_id", "n_bytes", *own, F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "page"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    name = F.concat(F.when(F.col("depth") > 0, F.expr(f"lpad(bin(prefix), depth, '0')")).otherwise(""), F.when(F.col("page") > 0, F.concat(F.lit("-"), "page")).otherwise(""))
    return out.select("doc_id", "n_bytes", "depth", "prefix", "page", name.alias("shard"), "shard_bytes", *own)


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet, a folder per shard and overflow page, each within the byte limit (or one document).

    Rows are numbered in a copy before they are placed, so that each goes to its own page though its key repeats; tasks
    take whole shards, so none is larger than a few of them. Folders are named `s` and the prefix bits, so that a reader
    takes them for text; the folder column is `shard`, with underscores behind it where the documents have such a column.
    """
    row, shard = unused(docs, "_row", "shard")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    placed = extendible_shards(rows, limit, key, text, carry=row).select(row, F.concat(F.lit("s"), "shard").alias(shard))
    rows.join(placed.hint("merge"), row).drop(row).repartition(shard).write.partitionBy(shard).parquet(path)
    discard(rows)


SHARD_BYTES = 1 << 20


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT depth::INTEGER AS depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
      FROM d, range(0, 46) AS r(depth) GROUP BY ALL),
f AS (SELECT d.doc_id, d.h, d.n_bytes, min(l.depth) AS depth
      FROM d, l WHERE l.prefix = d.h >> (60 - l.depth) AND (l.shard_bytes <= {SHARD_BYTES} OR l.n = 1) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, f.depth, l.prefix, 0::BIGINT AS page,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(l.prefix), f.depth, '0') END AS shard, l.shard_bytes
FROM f JOIN l ON l.depth = f.depth AND l.prefix = f.h >> (60 - f.depth)
"""
