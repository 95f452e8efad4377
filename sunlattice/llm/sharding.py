"""Proportional stratified interleaving: shards that all have the mixture of the whole.

Rows of a stratum are ranked in seeded-shuffled order, a row's place is (rank + jitter of the stratum) / rows of the
stratum, and the order of places is cut into runs whose lengths differ by one at most. Ranks come from two levels:
uniform blocks of the hash (or of the place) are counted, block counts are summed up to offsets, and only rows of one
block meet in a task, so a stratum with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut

#: Rows that are meant to be ranked together in one task.
BLOCK_ROWS = 20_000


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _fraction(digest: Column) -> Column:
    """A fraction in [0, 1) from the first 31 bits of a digest."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 2) / F.lit(float(1 << 31))


def _offsets(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    """For each block of each key: how many rows of the key lie in earlier blocks."""
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(block) if keys else Window.partitionBy(F.lit(0)).orderBy(block)
    return counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")


def interleave(df: DataFrame, n_shards: int, seed: int = 42, row_id: str = "doc_id", stratum: str = "source") -> DataFrame:
    """`df` with `shard` (0..n_shards-1) and `slot` (gapless from 0 in each shard).

    Row counts of shards differ by one at most, and a stratum of n rows has about n / n_shards in each. Null ids and
    null strata are values like any other (a stratum of their own); repeated rows each have a slot; an empty table gives
    an empty table; existing columns named shard or slot are replaced. The result depends on the rows alone, not on how
    they are partitioned.
    """
    base = df.drop("shard", "slot").withColumn("_hash", _seeded(seed, F.col(row_id)))
    base = base.withColumn("_tie", F.xxhash64(*[c for c in df.columns if c not in ("shard", "slot")]))
    total = base.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    key = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("null"))
    base = base.withColumn("_stratum", key).withColumn(
        "_block", F.floor(_fraction(F.col("_hash")) * F.lit(blocks)).cast("long")
    )
    inside = Window.partitionBy("_stratum", "_block").orderBy("_hash", "_tie")
    sizes = base.groupBy("_stratum").agg(F.count("*").alias("_size"))
    offsets = _offsets(base, ["_stratum"], "_block").join(sizes, "_stratum")
    ranked = (
        base.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, ["_stratum", "_block"])
        .withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    )
    jitter = _fraction(_seeded(seed, F.lit("stratum"), F.col("_stratum")))
    placed = ranked.withColumn("_place", (F.col("_rank") + jitter) / F.col("_size"))
    placed = cut(placed.drop("_before", "_size", "_block", "_rank"))
    placed = placed.withColumn("_cell", F.floor(F.col("_place") * F.lit(blocks)).cast("long"))
    order = Window.partitionBy("_cell").orderBy("_place", "_stratum", "_hash", "_tie")
    spot = (
        placed.withColumn("_at", F.row_number().over(order))
        .join(_offsets(placed, [], "_cell"), "_cell")
        .withColumn("_at", F.col("_at") + F.col("_before") - 1)
    )
    n = F.lit(n_shards).cast("long")
    rows = F.lit(total).cast("long")
    shard = F.expr(f"(_at * {n_shards}L) div {max(total, 1)}L")
    return (
        spot.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_at") - F.floor((F.col("shard") * rows + n - 1) / n))
        .drop("_hash", "_tie", "_stratum", "_cell", "_place", "_at", "_before")
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write `interleave`d rows as one folder a shard, rows in slot order."""
    spread = interleave(df, **options)
    ordered = spread.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def op4_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        "source",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    return interleave(narrow, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS stratum, encode(coalesce(text, '')) AS body,
         md5('42:' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) - 1 AS k,
         count(*) OVER (PARTITION BY stratum) AS n,
         md5('42:stratum:' || stratum) AS sh FROM d),
p AS (
  SELECT *, (k + (('0x' || substr(sh, 1, 8))::BIGINT // 2)::DOUBLE / 2147483648.0::DOUBLE) / n::DOUBLE AS place FROM r),
o AS MATERIALIZED (
  SELECT *, hex(body) AS hx, row_number() OVER (ORDER BY place, stratum, h) - 1 AS pos, count(*) OVER () AS total FROM p),
t AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM range(256) AS g(i))
SELECT doc_id, octet_length(body)::BIGINT + 1 AS size,
       xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(body)), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, (pos * 8 // total)::INTEGER AS shard,
       (pos - ((pos * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM o, t
"""
