"""Two-pass external shuffle into shards, with DataFrame operations alone.

Pass 1 scatters the rows into buckets by a seeded hash of the id and of the row's place in the input, and writes them; there are
as many buckets as it takes for one to fit in memory. So any rows spread evenly, repeated and null ids too, and what follows
reads one written table, whatever the input would give if it were computed again. Pass 2 puts a bucket's rows into one array and
shuffles it with Spark's seeded ``shuffle``, a Fisher-Yates shuffle. The buckets one after the other are the permutation; its n-th
row goes to shard n modulo the number of shards, as the slot n divided by it. So counts differ by one at most: the law ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, keep

#: Spark's aggregate of a task holds at most 128 buckets before it sorts.
BUCKET_BYTES = 2 << 20
#: What a row takes besides its ``weight``.
ROW_BYTES = 64
#: A task gets no more than this, but for its share of the session's number of shuffle partitions.
TASK_BYTES = 8 << 30


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffled(df: DataFrame, id_col: str, weight: Column | None = None, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, place): df's rows as structs and their place (from 0) in a seeded random permutation.

    weight: bytes of a row, if rows are large. Null and repeated ids, repeated rows and columns of any type and name are rows
    like all others. Rerunning over the same files and settings gives the same permutation, lost executors or not.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    scattered = df.select(F.xxhash64(F.lit(seed), F.col(id_col), at).alias("key"), at.alias("at"), (F.lit(ROW_BYTES) + (F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(0))).cast("long").alias("weight"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    scattered = keep(scattered, "scattered")
    total = scattered.agg(F.sum("weight")).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    rows = scattered.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    dealt = rows.select("bucket", "at", "row").repartition(width, "bucket").groupBy("bucket").agg(F.collect_list("at").alias("ats"), F.collect_list("row").alias("rows"))
    # rows are taken in the order of their places, so the seeded generator gives the same again
    order = F.sort_array(F.arrays_zip(F.col("ats").alias("at"), F.sequence(F.lit(0), F.size("ats") - 1).alias("i")))
    dealt = dealt.sortWithinPartitions("bucket").select("bucket", "rows", F.shuffle(order, F.lit(seed)).alias("order"))
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    group = F.floor(F.col("bucket") / 1024)
    groups = counted.groupBy(group.alias("g")).agg(F.sum("n").alias("s"))
    groups = groups.select("g", (F.sum("s").over(Window.orderBy("g")) - F.col("s")).alias("base"))
    starts = counted.withColumn("g", group).withColumn("inside", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n"))
    starts = starts.join(groups, "g").select("bucket", (F.col("inside") + F.col("base")).alias("start"))
    placed = dealt.join(starts, "bucket").select("start", F.posexplode(F.transform("order", lambda o: F.element_at("rows", o["i"] + 1))).alias("i", "row"))
    return placed.select("row", (F.col("start") + F.col("i")).cast("long").alias("place"))


def shards(df: DataFrame, id_col: str = "doc_id", n_shards: int = 16, weight: Column | None = None, seed: int = 11, **limits) -> DataFrame:
    """df's rows with ``shard`` and ``slot`` (gapless from 0 in every shard), under the law ``rows``; an empty table gives no rows.

    A column of df that is named shard or slot stays, under its name with underscores added until it is free. A null text weighs
    like an empty one; a very long one is a bucket with few others.
    """
    out = shuffled(df, id_col, weight, seed, **limits)
    columns = [F.col("row").getField(c).alias(n) for c, n in free_names(df.columns, ["shard", "slot"]).items()]
    return out.select(*columns, (F.col("place") % n_shards).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write each shard to a folder of its own, its rows in slot order, in files of some 64 thousand slots."""
    out = shards(df, **options)
    out.repartition("shard", F.floor(F.col("slot") / 65_536)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
