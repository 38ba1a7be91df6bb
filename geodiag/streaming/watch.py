"""Continuous checking of a folder with Structured Streaming.

Changed files have their modification time in their offset: :class:`ChangedFiles` is a stream
source over (time, path) and gives a row for each change, so a rewritten file is checked again.
A second stream, over the results, keeps each file's last score in state and tells changes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geodiag.config import Config
from geodiag.errors import GeodiagError
from geodiag.model import CheckContext
from geodiag.operators import rules, score
from geodiag.runtime import ship
from geodiag.sources.geoparquet import open_folder

RESULTS = "path string, findings long, overall int, grade string, checked timestamp"
CHANGES = "path string, checked timestamp, event string, findings long, overall int, grade string, previous int, change int, checks long"
TOLD = CHANGES.replace("checked timestamp", "at long")
#: files of a batch that are checked at once, and results that are written at once
AT_ONCE, BLOCK = 4, 64
#: groups of files by their paths' hashes; a checkpoint holds for one number
GROUPS = 1 << 14


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _after(self, start: dict) -> list[tuple[int, str]]:
        known = (start["time"], start["path"])
        found = []
        for base, _, names in os.walk(self.root):
            for n in names:
                p = os.path.join(base, n)
                try:
                    found.append((os.stat(p).st_mtime_ns, p))
                except OSError:
                    pass  # gone meanwhile
        return sorted(x for x in found if x > known)

    def read(self, start: dict):
        rows = self._after(start)
        end = {"time": rows[-1][0], "path": rows[-1][1]} if rows else start
        return iter([(p, t) for t, p in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(p, t) for t, p in self._after(start) if (t, p) <= (end["time"], end["path"])])

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    """``spark.readStream.format("changed_files").load(folder)``: ``path, mtime`` of new and rewritten files of a folder that the driver sees."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "path string, mtime long"

    def simpleStreamReader(self, schema):
        return _Changes(self.options["path"])


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").load(folder)


def check_file(spark: SparkSession, path: str, config: Config) -> Row | None:
    """One row of :data:`RESULTS`; None if the file isn't a readable dataset."""
    from geodiag.sources.files import read_file

    try:
        found = rules.run_checks(CheckContext(read_file(spark, path), config)).cache()
    except GeodiagError:
        return None
    try:
        total = score.overall(score.categories(found, config), found)
        return total.select(F.lit(path).alias("path"), F.col("finding_count").alias("findings"), "overall", "grade", F.current_timestamp().alias("checked")).first()
    finally:
        found.unpersist()


def watch(spark: SparkSession, folder: str, results: str, checkpoint: str, config: Config | None = None, once: bool = False):
    """Check each changed file and append its score to the Parquet table ``results``; returns the query."""
    config = config or Config()

    def handle(batch: DataFrame, epoch: int) -> None:
        # a batch names the files that changed since the last one, not their rows; each gives one row
        paths = (r.path for r in batch.select("path").distinct().toLocalIterator())
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while block := list(islice(paths, BLOCK)):
                if rows := [r for r in pool.map(lambda p: check_file(spark, p, config), block) if r is not None]:
                    spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(results)

    writer = changed_files(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


class LastScores(StatefulProcessor):
    """The last scores of a group of files as state, times in microseconds. After ``silence_ms`` without a check a file is asked whether it is still there.

    Each call of the state goes from the worker to the JVM and back, which costs more than a file's checks; so files share
    the calls in groups, whose rows come as columns, and a group has one timer, for the first of its files that is due. A file's own time is left as it is by
    checks: when it comes before the silence is over, it is set anew.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due, timer: milliseconds
        self.last = handle.getValueState("last", "files array<struct<path:string,overall:int,grade:string,findings:long,at:long,checks:long,due:long>>, timer long")

    def _known(self) -> tuple[dict[str, tuple], int | None]:
        state = self.last.get()
        return ({f[0]: tuple(f)[1:] for f in state[0]}, state[1]) if state is not None else ({}, None)

    def _keep(self, files: dict[str, tuple], timer: int | None) -> None:
        """``timer``: the one that is set."""
        if not files:
            self.last.clear()
            return
        due = min(f[-1] for f in files.values())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.last.update(([(p, *f) for p, f in files.items()], timer))

    @staticmethod
    def _told(out: list[tuple]) -> Iterator[pd.DataFrame]:
        # objects, as numbers may be null
        return iter([pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")], dtype=object)] if out else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        files, timer = self._known()
        now = None
        # a batch has a file's checks since the last batch, so few
        of = (zip(*(part[c].tolist() for c in ("path", "at", "overall", "findings", "grade"))) for part in rows)
        for path, at, overall, findings, grade in sorted(chain.from_iterable(of), key=lambda r: r[:4]):
            known = files.get(path)
            if known is not None and at <= known[3]:
                continue  # told again, or overtaken
            before, checks = (None, 0) if known is None else (known[0], known[4])
            if known is None or (overall, findings) != (known[0], known[2]):
                event = "new" if known is None else "better" if (overall, -findings) > (known[0], -known[2]) else "worse"
                out.append((path, at, event, findings, overall, grade, before, None if before is None else overall - before, checks + 1))
            if known is None:
                now = timerValues.getCurrentWatermarkInMs() if now is None else now
                due = None
            else:
                due = known[5]
            files[path] = (overall, grade, findings, at, checks + 1, due)
        for p, f in files.items():
            if f[5] is None:
                files[p] = (*f[:5], max(f[3] // 1000, now) + self.silence_ms)
        self._keep(files, timer)
        return self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentWatermarkInMs()
        files, _ = self._known()
        for p, (overall, grade, findings, at, checks, due) in list(files.items()):
            if due > now:
                continue
            due = at // 1000 + self.silence_ms
            if due <= now:
                where, path = open_folder(p)
                due = now + self.silence_ms if where.get_file_info(path).type != fs.FileType.NotFound else None
            if due is not None:
                files[p] = (overall, grade, findings, at, checks, due)
                continue
            del files[p]
            out.append((p, at, "vanished", findings, None, None, overall, None, checks))
        self._keep(files, None)
        return self._told(out)

    def close(self) -> None:
        pass


def score_changes(results: DataFrame, silence: int = 600, late: str = "1 minute") -> DataFrame:
    """Changes of each file's score, from a stream of :data:`RESULTS`, as rows of :data:`CHANGES`.

    ``event``: new (first check, or the first after it vanished), better or worse (by score, then by
    fewer findings), vanished (gone when asked after ``silence`` seconds of event time without a
    check; ``checked`` is then its last check's time, ``findings`` that check's). A check that changes
    nothing only counts in ``checks``; one not later than the last known is ignored, so results that
    a repeated batch tells again change nothing; one without a path, score, findings or time is
    ignored. Event time is that of all results, so a folder in which nothing is checked any more
    tells nothing. Executors must see the files, as they do to check them.
    """
    spark = results.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = results.where("path is not null and overall is not null and findings is not null and checked is not null").withWatermark("checked", late)
    group = F.pmod(F.xxhash64("path"), F.lit(GROUPS)).alias("files")
    told = known.select(group, "path", "findings", "overall", "grade", "checked", F.unix_micros("checked").alias("at")).groupBy("files").transformWithStateInPandas(LastScores(silence * 1000), TOLD, "Append", "EventTime")
    return told.select("path", F.timestamp_micros("at").alias("checked"), "event", "findings", "overall", "grade", "previous", "change", "checks")


def watch_changes(spark: SparkSession, results: str, changes: str, checkpoint: str, once: bool = False, silence: int = 600, late: str = "1 minute"):
    """Append :func:`score_changes` of the Parquet table ``results`` to the table ``changes``; returns the query. Restarted on its checkpoint, it goes on from its state."""
    where, root = open_folder(results)
    where.create_dir(root, recursive=True)  # the stream may start before the first result
    writer = score_changes(spark.readStream.schema(RESULTS).parquet(results), silence, late).writeStream.format("parquet").outputMode("append").option("path", changes).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def last_scores(results: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The last row of :data:`RESULTS` for each file, without those that vanished after it by ``changes``; of equal times the higher score, then fewer findings."""
    last = results.where("path is not null").groupBy("path").agg(F.max_by(F.struct("findings", "overall", "grade", "checked"), F.struct("checked", "overall", (-F.col("findings")).alias("fewer"))).alias("r")).select("path", "r.*")
    if changes is None:
        return last
    gone = changes.where("event = 'vanished'").groupBy("path").agg(F.max("checked").alias("gone"))
    return last.join(gone, "path", "left").where("gone is null or checked > gone").drop("gone")


def score_trend(results: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Mean and least score of each file in windows of event time; works on a stream of results too."""
    stamped = results.withWatermark("checked", late) if results.isStreaming else results
    return stamped.groupBy(F.window("checked", width), "path").agg(F.avg("overall").alias("mean_score"), F.min("overall").alias("least_score"), F.count(F.lit(1)).alias("checks"))
