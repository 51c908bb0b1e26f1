"""The change stream: sources, bundling, stateful upserts, fan-out and timeouts.

Leases, checkpoints and task retries are Structured Streaming's own: one query per
checkpoint folder, and that folder. State kept between batches is a versioned
table, which a new process takes up where the last one stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quarry.operators.tables import latest, runs
from quarry.session import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stored table, a file or a folder of files, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", retries: int = 0, wait: float = 1.0, longest: float = 60.0
) -> list[dict]:
    """Run everything there is through foreachBatch, then stop; returns batch, records
    and milliseconds of the last run's batches, as many as Spark keeps. The checkpoint is a
    query's lease and its position. A failed run starts again from it up to retries
    times, after wait seconds, doubled each time up to longest."""
    for left in range(retries, -1, -1):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        try:
            query.awaitTermination()
            return [{"batch": p.batchId, "records": p.numInputRows, "milliseconds": p.batchDuration} for p in query.recentProgress if p.numInputRows]
        except StreamingQueryException:
            if not left:
                raise
            time.sleep(min(longest, wait * 2 ** (retries - left)))


def poll(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, budget: float, share: float = 0.9, wait: float = 1.0, longest: float = 30.0) -> int:
    """Drain again and again until a share of the budget of seconds is used up;
    the pause doubles up to longest while nothing arrives. Returns the batches seen."""
    began, seen, pause = time.monotonic(), 0, wait

    def counted(batch: DataFrame, batch_id: int) -> None:
        nonlocal seen
        seen += 1
        each(batch, batch_id)

    while True:
        before = seen
        drain(stream, counted, checkpoint)
        pause = wait if seen > before else min(longest, pause * 2)
        if time.monotonic() - began + pause > share * budget:
            return seen
        time.sleep(pause)


def bundled(records: DataFrame, optimised: bool = False) -> DataFrame:
    """records (commit_num, op_num, key, op) with bundle: runs of one operation per
    key, within a commit or, optimised, across commits; order is kept."""
    keys = ["key"] if optimised else ["commit_num", "key"]
    return runs(records, keys, ["commit_num", "op_num"], "op")


class Versions:
    """A table as parquet versions, one per micro-batch, in the shared folder.

    A new object on the same path goes on from what is there. A batch that comes
    again after a failure starts from the version before it and writes its own
    version anew, so it applies once; a version is read only when it is complete,
    and never overwritten while it is read. The newest kept versions stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, kept: int = 3):
        self.spark, self.path, self.kept = spark, path or scratch(spark), kept

    def _folder(self, path: str) -> tuple[Any, Any]:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def committed(self) -> list[int]:
        files, root = self._folder(self.path)
        if not files.exists(root):
            return []
        names = [f.getPath().getName() for f in files.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[1]))

    def before(self, batch_id: int) -> DataFrame | None:
        """The version that batch_id builds on, if any."""
        earlier = [v for v in self.committed() if v < batch_id]
        return self.spark.read.parquet(f"{self.path}/{earlier[-1]}") if earlier else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        for old in [v for v in self.committed() if v <= batch_id][: -self.kept]:
            files, path = self._folder(f"{self.path}/{old}")
            files.delete(path, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.committed()[-1]}")


class Merged(Versions):
    """Rows by key as runs, one per micro-batch, in the shared folder; the newest row
    of a key holds, and rows that are gone hide older ones.

    A batch writes the rows of its own keys, not the table. Before it, the newest runs are
    merged into one as soon as they are together half as large as the one before
    them, so every row is rewritten as often as the table doubles, and a reader
    meets few runs. A run is named by its first and last batch and counts once it
    is complete; a merge holds finished batches only, so a repeated batch writes its
    own run anew, and what a merge replaced stays until the next batch, for who
    reads it still. A batch that is already merged cannot come again: that is an error.
    """

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None):
        super().__init__(spark, path)
        self.keys = keys

    def runs(self) -> list[tuple[int, int]]:
        """All complete runs, by first and last batch."""
        files, root = self._folder(self.path)
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        found = [tuple(map(int, n.split("-"))) for n in names if n.replace("-", "", 1).isdigit() and "-" in n]
        return sorted(r for r in found if files.exists(self._folder(f"{self.path}/{r[0]}-{r[1]}/_SUCCESS")[1]))

    def committed(self) -> list[int]:
        return sorted({last for _, last in self.runs()})

    def live(self, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The runs that no other one holds, oldest first."""
        return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]

    def _bytes(self, run: tuple[int, int]) -> int:
        files, path = self._folder(f"{self.path}/{run[0]}-{run[1]}")
        return files.getContentSummary(path).getLength()

    def _rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        """The newest row of each key, those that are gone included."""
        each = [self.spark.read.parquet(f"{self.path}/{a}-{b}").withColumn("_run", F.lit(b)) for a, b in runs]
        if len(each) == 1:
            return each[0].drop("_run")
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), each)
        return latest(rows, self.keys, [F.col("_run")]).drop("_run")

    def before(self, batch_id: int) -> DataFrame | None:
        runs = self.live([r for r in self.runs() if r[1] < batch_id])
        return self._rows(runs).where("not _gone").drop("_gone") if runs else None

    def read(self) -> DataFrame:
        return self._rows(self.live(self.runs())).where("not _gone").drop("_gone")

    def _compact(self, batch_id: int) -> None:
        runs = self.runs()
        if any(first <= batch_id < last or first < batch_id <= last for first, last in runs):
            raise ValueError(f"batch {batch_id} of {self.path} is merged with others already")
        earlier = [r for r in runs if r[1] < batch_id]
        live = self.live(earlier)
        for first, last in set(earlier) - set(live):
            files, path = self._folder(f"{self.path}/{first}-{last}")
            files.delete(path, True)
        sizes = [self._bytes(r) for r in live]
        at = len(live) - 1
        while at > 0 and sum(sizes[at:]) * 2 >= sizes[at - 1]:
            at -= 1
        if len(live) - at > 1:
            rows = self._rows(live[at:])
            rows = rows if at else rows.where("not _gone")  # nothing older is left to hide
            rows.write.mode("overwrite").parquet(f"{self.path}/{live[at][0]}-{live[-1][1]}")

    def write(self, rows: DataFrame, batch_id: int, gone: Column | None = None) -> None:
        """One row per key; a row for which gone holds hides its key."""
        self._compact(batch_id)
        flag = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
        rows.withColumn("_gone", flag).write.mode("overwrite").parquet(f"{self.path}/{batch_id}-{batch_id}")


class StateTable(Merged):
    """Current rows by key; of several changes of a key the last in order wins, and a
    change for which gone holds removes its key. What a batch writes follows the batch."""

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], path: str | None = None):
        super().__init__(spark, keys, path)
        self.order = order

    def merge(self, batch: DataFrame, batch_id: int, gone: Column | None = None) -> None:
        last = latest(batch.withColumn("_last", F.lit(False) if gone is None else gone), self.keys, [*map(F.col, self.order)])
        self.write(last.select(*batch.columns, F.col("_last").alias("_gone")), batch_id, F.col("_gone"))


class Documents:
    """Search documents of entities, kept up from changes of their values.

    records (commit_num, op_num, key, op ADD or REMOVE, field, value). Values are keyed
    state of their own, so removing one needs no old document; a batch rewrites the
    documents of its entities only, and an entity without values has none.
    A document (key, fields: map of field to its sorted values) is one row. A null
    key is a key like any other; null fields and null values are in no document.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        root = path or scratch(spark)
        self.values = StateTable(spark, ["key", "field", "value"], ["commit_num", "op_num"], f"{root}/values")
        self.index = StateTable(spark, ["key"], [], f"{root}/documents")

    def add(self, records: DataFrame, batch_id: int) -> None:
        self.values.merge(records.select("key", "field", "value", "commit_num", "op_num", "op"), batch_id, F.col("op") == "REMOVE")
        touched = records.select("key").distinct()
        held = self.values.read().where("field is not null and value is not null").select(F.col("key").alias("k"), "field", "value")
        fields = touched.join(held, F.col("key").eqNullSafe(F.col("k")), "left").groupBy("key", "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
        entry = F.when(F.col("field").isNotNull(), F.struct("field", "values"))
        found = fields.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
        self.index.write(found, batch_id, F.size("fields") == 0)

    def read(self) -> DataFrame:
        return self.index.read()


class Bundles:
    """Bundle numbers over many micro-batches, as `bundled` gives them over all
    records at once. Batches follow commit order; a commit may be cut by their
    border: the last operation and bundle of every open key are carried on, of the
    last commit, or optimised, of every key; then a batch writes those of its own keys."""

    def __init__(self, spark: SparkSession, optimised: bool = False, path: str | None = None):
        root = path or scratch(spark)
        self.keys = ["key"] if optimised else ["commit_num", "key"]
        self.optimised, self.out = optimised, f"{root}/bundles"
        self.state = Merged(spark, self.keys, f"{root}/state") if optimised else Versions(spark, f"{root}/state")

    def add(self, records: DataFrame, batch_id: int) -> None:
        found = bundled(records, self.optimised)
        order = F.struct("commit_num", "op_num")
        carried = self.state.before(batch_id)
        if carried is not None:
            first = records.groupBy(*self.keys).agg(F.min_by("op", order).alias("_first"))
            shift = F.col("last_bundle") - (F.col("_first") == F.col("last_op")).cast("int")
            shifts = first.join(carried, self.keys).select(*self.keys, shift.alias("_shift"))
            found = found.join(shifts, self.keys, "left").withColumn("bundle", F.col("bundle") + F.coalesce("_shift", F.lit(0))).drop("_shift")
        found.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        found = records.sparkSession.read.parquet(f"{self.out}/batch={batch_id}")
        last = found.groupBy(*self.keys).agg(F.max_by("op", order).alias("last_op"), F.max_by("bundle", order).alias("last_bundle"))
        if not self.optimised:
            if carried is not None:
                last = last.unionByName(carried.join(last.select(*self.keys), self.keys, "left_anti"))
            newest = last.agg(F.max("commit_num").alias("newest"))
            last = last.join(F.broadcast(newest), F.col("commit_num") == F.col("newest")).drop("newest")
        self.state.write(last, batch_id)


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes one batch to several tables under root, read once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, stage in sinks.items():
                stage(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return each


def with_timeouts(jobs: DataFrame, seconds: int = 7200) -> DataFrame:
    """(job, status): done when a job's end event arrives, timed_out when event time
    passes `seconds` after its last event. jobs (job, status, ts timestamp) needs a
    watermark on ts."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "status": ["timed_out"]})
            return
        last, done = state.get[0] if state.exists else 0, False
        for frame in frames:
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
            done = done or bool((frame["status"] == "done").any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"job": [key[0]], "status": ["done"]})
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return jobs.groupBy("job").applyInPandasWithState(follow, "job bigint, status string", "last bigint", "append", "EventTimeTimeout")


class LagListener(StreamingQueryListener):
    """Keeps records processed and the batch duration of each progress report."""

    def __init__(self) -> None:
        self.reports: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.reports.append({"batch": p.batchId, "records": p.numInputRows, "milliseconds": p.batchDuration})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts per type and tumbling window (an extension: the source of these
    operators has no windows). ts must be a timestamp for the watermark."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    )
