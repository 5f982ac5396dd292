"""Shared pieces of every job: scratch tables, checked broadcasts, ranks that spread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows that one task ranks at most, about.
RANK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session. Where it is unset a local master gets a temporary folder;
    a cluster without it is an error, since executors don't see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back; the lineage ends there.

    The tables live in one folder per application, which may go once the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsfold-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is (then the join shuffles).

    df is counted for that, so pass a written table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def parts(spark: SparkSession, rows: int, per_part: int = RANK_ROWS) -> int:
    """A number of buckets that grows with the rows and is never below the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: int, name: str = "rank") -> DataFrame:
    """df with a gapless rank from 0 within keys, though no task sees all rows of a key.

    Rows are dealt to buckets by a hash of the order columns; a bucket's ranks start after those of the buckets before
    it. Rows are in bucket order, then by the order columns: a fixed order, but not a sorted one.
    """
    b, at = f"__{name}_bucket", f"__{name}_before"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by_bucket = Window.partitionBy(*keys, b)
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(at))
    on = F.col(b) == F.col("__b")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = dealt.withColumn("__at", F.row_number().over(by_bucket.orderBy(*order)))
    return numbered.join(counts, on).withColumn(name, F.col(at) + F.col("__at") - 1).select(*df.columns, name)


def in_order(df: DataFrame, columns: Sequence[str], bucket: str, rank: str, per_part: int = RANK_ROWS) -> tuple[DataFrame, DataFrame]:
    """df, written, with a gapless ``rank`` from 0 in the order of columns over all rows, and the ``bucket`` that holds a row.

    Buckets are ranges of the order of about per_part rows, whatever the keys: a hot key lies in many. Rows that agree in all
    columns are dealt by their place in df. Second: (bucket, start, size) of the buckets that have rows; start is their first rank.
    """
    spark = df.sparkSession
    tie, at = free_name(df, "__tie"), free_name(df, "__at")
    n = parts(spark, df.count(), per_part)
    # the id that is given last is the sorted partition's number and the row's place in it
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *columns, tie).sortWithinPartitions(*columns, tie)
    dealt = written(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    own = F.shiftright(at, 33).cast("int").alias(bucket)
    sizes = dealt.groupBy(own).agg(F.count(F.lit(1)).alias("size"))
    # a row for each bucket, n at most
    starts = written(sizes.select(bucket, (F.sum("size").over(Window.orderBy(bucket)) - F.col("size")).alias("start"), "size"))
    found = dealt.select("*", own).join(small(starts.select(bucket, "start")), bucket)
    return found.select(*df.columns, bucket, (F.col("start") + F.col(at).bitwiseAND((1 << 33) - 1)).alias(rank)), starts


def with_halo(rows: DataFrame, starts: DataFrame, bucket: str, rank: str, n: int) -> DataFrame:
    """rows of ``in_order`` with ``halo``: false of a bucket's own rows; true of the n rows before its first one, put into it again.

    The rows before may lie in several buckets if these have fewer than n.
    """
    ends = starts.select(F.col(bucket).alias("__b"), (F.col("start") + F.col("size")).alias("__end"))
    tails = rows.join(small(ends), F.col(bucket) == F.col("__b")).where(F.col(rank) >= F.col("__end") - n)
    tails = tails.withColumn("__start", F.explode(F.sequence(F.col(rank) + 1, F.col(rank) + n)))
    tails = tails.join(small(starts.select(F.col("start").alias("__start"), F.col(bucket).alias("__to"))), "__start")
    again = tails.select(*[F.col("__to").alias(c) if c == bucket else F.col(c) for c in rows.columns], F.lit(True).alias("halo"))
    return rows.withColumn("halo", F.lit(False)).unionByName(again)


def lagged(df: DataFrame, key: str, order: str, bucket: Column, name: str, value: str) -> DataFrame:
    """df with ``name``: the value of the row before, within a key and by order, though no task sees all rows of a key.

    bucket rises with the order, as a time's hour does. A bucket's first row takes the last value of the bucket before, of
    which there is one row a bucket.
    """
    b, k, at, end = (free_name(df, f"__{x}") for x in ("bucket", "key", "at", "end"))
    rows = df.withColumn(b, bucket)
    last = rows.groupBy(F.col(key).alias(k), F.col(b).alias(at)).agg(F.max_by(value, order).alias(end))
    last = last.withColumn(end, F.lag(end).over(Window.partitionBy(k).orderBy(at)))
    own = Window.partitionBy(key, b).orderBy(order)
    rows = rows.withColumn(name, F.lag(value).over(own)).withColumn(f"{b}_first", F.row_number().over(own) == 1)
    joined = rows.join(last, F.col(key).eqNullSafe(F.col(k)) & F.col(b).eqNullSafe(F.col(at)), "left")
    return joined.select(*df.columns, F.when(F.col(f"{b}_first"), F.col(end)).otherwise(F.col(name)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it differ from all columns of df (without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
