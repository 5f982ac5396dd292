"""Incremental runs: the catalogue under a stream of stub files, de-duplication with a watermark, newest-time state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from newsfold.functions.runtime import free_name, shared_dir, small, written
from newsfold.operators.catalogue import prune_catalogue, upsert_catalogue
from newsfold.operators.stubs import source_settings

MAX_AGE = "21 days"


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


class Catalogue:
    """Snapshots of a catalogue in a folder, in hash buckets of the entries' places.

    A snapshot is a manifest: which version of each bucket it has, and the largest place so far. A batch writes the buckets that it changes, as
    its own version, and the next manifest, so that what it writes follows the batch and a repeated batch changes nothing. The last ``keep`` snapshots
    stay (two at least, as a batch that is repeated starts from the one before), and the versions that they name. A folder that
    has snapshots goes on from them: ``first`` and ``buckets`` aren't used.
    """

    def __init__(self, spark: SparkSession, folder: str, first: DataFrame, keep: int = 2, buckets: int = 64):
        self.spark, self.folder, self.schema, self.keep, self.buckets = spark, folder, first.schema, max(2, keep), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if (last := self.last()) is None:
            self.write(first, -1)
        else:
            self.buckets = self._manifest(last)[2]

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.folder}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _batches(self) -> list[int]:
        """The batches that have a finished snapshot."""
        return sorted(int(n) - 1 for n in self._names("manifest") if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/manifest/{n}/_SUCCESS")))

    def _manifest(self, batch: int) -> tuple[dict[int, int], int, int]:
        """Of a snapshot: bucket -> version, the largest place, the number of buckets; a row for each bucket that has entries, and one more."""
        rows = self.spark.read.schema("bucket int, version int, top long").parquet(f"{self.folder}/manifest/{batch + 1:012d}").collect()
        (own,) = (r for r in rows if r.bucket == -1)
        return {r.bucket: r.version for r in rows if r.bucket >= 0}, own.top, own.version

    def last(self) -> int | None:
        """The number of the last batch, -1 before the first."""
        return max(self._batches(), default=None)

    def top(self, batch: int) -> int:
        """The largest place that an entry has had by then; -1 without entries."""
        return self._manifest(batch)[1]

    def at(self, batch: int) -> DataFrame:
        """The entries after a batch."""
        return self._read(self._manifest(batch)[0])

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={k}" for k, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> None:
        """Make df the snapshot after a batch, in all buckets."""
        df = written(df)
        self._put(df, batch, {}, df.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0])

    def change(self, batch: int, rows: DataFrame, gone: DataFrame, top: int) -> None:
        """The snapshot after a batch is the one before it without the entries of ``gone`` (idx), and with ``rows`` in place of those with their idx.

        Only buckets that hold one of both are read and written.
        """
        ids = written(rows.select("idx").unionByName(gone.select("idx")).distinct())
        touched = {r[0] for r in ids.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        old = self._manifest(batch - 1)[0]
        stay = self._read({k: v for k, v in old.items() if k in touched}).join(small(ids), "idx", "left_anti")
        self._put(stay.select(self.schema.names).unionByName(rows.select(self.schema.names)), batch, {k: v for k, v in old.items() if k not in touched}, top)

    def _bucket(self):
        return F.pmod(F.xxhash64("idx"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _put(self, df: DataFrame, batch: int, stay: dict[int, int], top: int) -> None:
        version = batch + 1
        df.select(*self.schema.names, self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/version={version}")
        made = {int(n.split("=")[1]): version for n in self._names(f"data/version={version}") if n.startswith("bucket=")}
        rows = [(k, v, None) for k, v in (stay | made).items()] + [(-1, self.buckets, top)]
        self.spark.createDataFrame(rows, "bucket int, version int, top long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version:012d}")
        for old in self._batches():
            if old <= batch - self.keep:
                self._fs.delete(self._path(f"{self.folder}/manifest/{old + 1:012d}"), True)
        named = {f"version={v}/bucket={k}" for b in self._batches() for k, v in self._manifest(b)[0].items()}
        for v in self._names("data"):
            if all(f"{v}/{n}" not in named for n in self._names(f"data/{v}")):
                self._fs.delete(self._path(f"{self.folder}/data/{v}"), True)


def stream_ingest(stubs: DataFrame, store: Catalogue, sources: DataFrame, now, checkpoint: str) -> int:
    """Upsert and prune the catalogue with every batch of catalogue rows that a stream brings; the number of the last batch.

    The stream takes what is there and ends; with nothing new the catalogue stays at the last batch of an earlier run.
    Rows older than their source allows are dropped by the prune. A batch reads the signatures of all entries, changes those that it meets, and
    writes their buckets. The first batch of a run prunes all entries; from then on only entries of outlets with a limit can be pushed out, by
    rows of a batch: these outlets' entries, as many as the limits allow, are the rivals that are carried on.
    """
    limited = written(source_settings(sources).where("max_num_articles is not null").select(F.col("name").alias("outlet")))
    rivals: dict[int, DataFrame] = {}

    def step(batch: DataFrame, number: int) -> None:
        batch, before, top = written(batch), store.at(number - 1), store.top(number - 1)
        asked = written(batch.select(F.explode("urls.sign").alias("sign")).where("sign <> ''").distinct())
        met = before.select("idx", F.explode("urls.sign").alias("sign")).join(small(asked), "sign", "left_semi").select("idx").distinct()
        met = written(before.join(small(written(met)), "idx", "left_semi"))
        rows = written(upsert_catalogue(met, batch, top=top))
        keys = ["idx", "updated", "outlet"]
        others = rivals[number - 1] if number - 1 in rivals else before.select(keys)
        judged = written(others.join(small(met.select("idx")), "idx", "left_anti").unionByName(rows.select(keys)))
        kept = written(prune_catalogue(judged, sources, now))
        gone = written(judged.join(kept, "idx", "left_anti").select("idx"))
        store.change(number, rows.join(small(gone), "idx", "left_anti"), gone, rows.agg(F.greatest(F.max("idx"), F.lit(top))).first()[0] or top)
        rivals[number] = written(kept.join(small(limited), "outlet", "left_semi").select(keys))
        rivals.pop(number - 1, None)

    stubs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.last()


def stream_dedup(stubs: DataFrame, key: str = "signature", time: str = "ts", delay: str = MAX_AGE) -> DataFrame:
    """The first stub of each key within the watermark's delay; state older than that goes."""
    return stubs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


#: Groups of keys whose state is kept together: a call of Python a group and batch, however many keys there are.
KEY_BUCKETS = 2048


def stream_needs_update(stubs: DataFrame, key: str = "signature", time: str = "ts", delay: str = MAX_AGE, buckets: int = KEY_BUCKETS) -> DataFrame:
    """(key, ts) of stubs that are later than all before them with their key, up to ``delay`` of silence.

    Keys are dealt to buckets by their hash. A bucket's state has each key with its latest time and until when it is kept.
    """
    silence = int(pd.Timedelta(delay).total_seconds() * 1000)
    never = np.iinfo(np.int64).min

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (t, until) for k, t, until in zip(*state.get, strict=True)} if state.exists else {}
        mark = state.getCurrentWatermarkMs()
        latest: dict = {}
        if not state.hasTimedOut:
            rows = pd.concat([pdf[["key", "t"]] for pdf in batches]).dropna(subset=["t"]).drop_duplicates().sort_values("t", kind="stable")
            before = np.array([held.get(k, (never,))[0] for k in rows["key"]], dtype=np.int64)
            latest = dict(zip(rows["key"].tolist(), rows["t"].astype("int64").tolist(), strict=True))  # of a key the last one stays
            yield rows[rows["t"].to_numpy() > before]
        held = {k: v for k, v in held.items() if v[1] >= mark or k in latest}
        for k, t in latest.items():
            seen = max(t, held[k][0]) if k in held else t
            held[k] = (seen, max(seen // 1000 + silence, mark + 1))
        if held:
            state.update((list(held), [t for t, _ in held.values()], [until for _, until in held.values()]))
            state.setTimeoutTimestamp(max(min(until for _, until in held.values()), mark + 1))
        elif state.exists:
            state.remove()

    rows = stubs.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", delay).withColumn("t", F.unix_micros("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(step, "key string, t long", "keys array<string>, seen array<long>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def late_data(stubs: DataFrame, cut, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows in time, counts of late rows by outlet): rows before the cut are late."""
    late = F.col(time) < cut
    return stubs.where(~late), stubs.where(late).groupBy("outlet").agg(F.count(F.lit(1)).alias("n"))


def stream_late(stubs: DataFrame, folder: str, checkpoint: str, time: str = "ts", delay: str = MAX_AGE) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a stream, as tables in a folder: late is what lies more than ``delay`` before the latest
    time of the batches before its own.

    Spark's watermark drops late rows without a word; here they are a side output. A batch is read once: while its rows are written, by
    their side, their latest time is observed. It is kept with the batch, and a batch's folders are overwritten, so that a repeated batch
    changes nothing. The stream takes what is there and ends.
    """
    spark, schema = stubs.sparkSession, stubs.schema
    kind, side = schema[time].dataType.simpleString(), free_name(stubs, "side")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def step(batch: DataFrame, number: int) -> None:
        mark = f"{folder}/latest/batch={number - 1}"
        latest = spark.read.schema(f"latest {kind}").parquet(mark).first()[0] if number > 0 and fs.exists(path(mark)) else None
        late = F.lit(False) if latest is None else F.coalesce(F.col(time) < F.lit(latest) - F.expr(f"interval {delay}"), F.lit(False))
        seen = Observation(f"late-{uuid.uuid4().hex}")
        told = batch.withColumn(side, F.when(late, "late").otherwise("in_time")).observe(seen, F.max(time).alias("latest"))
        told.write.partitionBy(side).mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        times = [t for t in (seen.get["latest"], latest) if t is not None]
        spark.createDataFrame([(max(times, default=None),)], f"latest {kind}").coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest/batch={number}")

    stubs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not fs.exists(path(f"{folder}/rows")):
        return spark.createDataFrame([], schema), spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField(side, StringType())])).parquet(f"{folder}/rows")
    return tuple(rows.where(F.col(side) == k).select(*schema.names) for k in ("in_time", "late"))
