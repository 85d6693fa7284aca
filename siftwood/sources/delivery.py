"""Delivery with a journal: what was sent is on disk before the task goes on, so a failure half way resends what was not sent.

A data source writes messages by posting them. A task notes every few posts in a file of its own in the journal; an attempt that is run again reads the notes of
those before it. The commit messages of the tasks become one line of the log of runs. A run starts from what no earlier run, whole or cut
short, has sent. So each message is sent at least once, and again only if its task ended between the post and the note: at most
`every` posts a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shared import written
from ..shipping import ship_package

MESSAGE = "id STRING, recipient STRING, message STRING"
NOTE = "id STRING, recipient STRING, delivered BOOLEAN, error STRING, run STRING"
RUN = "run STRING, whole BOOLEAN, tasks BIGINT, delivered BIGINT, failed BIGINT"
SOURCE = "siftwood_outbox"


def _files(path: str):
    from pyarrow import fs

    local = path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"file:///{local.lstrip('/')}" if local.startswith("/") else path)


def _put(path: str, lines: list[dict]) -> None:
    """Writes a file beside its place and moves it there: a note is whole or not there. Names that begin with _ are not read by Spark."""
    fs, at = _files(path)
    folder, name = at.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
    fs.move(draft, at)


def _noted(path: str) -> set[str]:
    """Ids that the notes in a task's folder call delivered."""
    from pyarrow import fs as pafs

    fs, at = _files(path)
    sent = set()
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.base_name.startswith("_"):
            continue
        with fs.open_input_stream(info.path) as file:
            notes = (json.loads(line) for line in file.readall().splitlines())
            sent |= {n["id"] for n in notes if n["delivered"]}
    return sent


@dataclass
class Sent(WriterCommitMessage):
    delivered: int
    failed: int


class Poster(DataSourceArrowWriter):
    """Posts a task's messages in turn and notes them; a post that raises is a note with its error, not the end."""

    def __init__(self, post: Callable[[str, str], None], path: str, run: str, every: int):
        self.post, self.path, self.run, self.every = post, path, run, every

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        place = f"{self.path}/journal/run={self.run}/task={number}"
        sent, notes, failed = _noted(place), [], 0
        done = len(sent)

        def note() -> None:
            if notes:
                _put(f"{place}/{uuid.uuid4().hex}.json", notes)
                notes.clear()

        for batch in iterator:
            for id, recipient, message in zip(*(batch.column(c).to_pylist() for c in ("id", "recipient", "message")), strict=True):
                if id in sent:
                    continue
                error = None
                try:
                    self.post(recipient, message)
                except Exception as e:  # noqa: BLE001  one failed delivery is a note, not the end
                    error = f"{type(e).__name__}: {e}"
                notes.append({"id": id, "recipient": recipient, "delivered": error is None, "error": error})
                done, failed = done + (error is None), failed + (error is not None)
                if len(notes) >= self.every:
                    note()
        note()
        return Sent(done, failed)

    def _log(self, messages: list[Sent | None], whole: bool) -> None:
        told = [m for m in messages if m is not None]
        _put(f"{self.path}/runs/{self.run}.json", [{"run": self.run, "whole": whole, "tasks": len(told), "delivered": sum(m.delivered for m in told), "failed": sum(m.failed for m in told)}])

    def commit(self, messages: list[Sent | None]) -> None:
        self._log(messages, True)

    def abort(self, messages: list[Sent | None]) -> None:
        self._log(messages, False)


def outbox(post: Callable[[str, str], None]) -> type[DataSource]:
    """The data source that writes by post(recipient, message). Options: path of the journal, run, every."""

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return SOURCE

        def schema(self) -> str:
            return MESSAGE

        def writer(self, schema, overwrite) -> Poster:
            return Poster(post, self.options["path"].rstrip("/"), self.options["run"], int(self.options.get("every", "20")))

    return Outbox


def _read(spark: SparkSession, path: str, folder: str, ddl: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("recursiveFileLookup", folder == "runs").json(f"{path}/{folder}")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(id, recipient, delivered, error, run): every post that was noted, of whole runs and of those cut short."""
    return _read(spark, path, "journal", NOTE).select("id", "recipient", "delivered", "error", "run")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, whole, tasks, delivered, failed): a row a run that was told its end; a cut run counts only tasks that had ended."""
    return _read(spark, path, "runs", RUN)


def deliver_pending(messages: DataFrame, path: str, run: str, post: Callable[[str, str], None], every: int = 20) -> None:
    """Posts the messages (id, recipient, message; id unique) that the journal at path does not call delivered; other columns are ignored.

    Of messages of one id the least by recipient and message counts; null ids are left out, a null message is posted as empty. path lies in a folder that driver and executors share. Failed posts are tried
    again by the next run. Two runs at once, and attempts that run beside another (speculation), would post twice: the latter is an error.
    """
    spark = messages.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise RuntimeError("delivery posts twice under spark.speculation: turn it off")
    path = path.rstrip("/")
    ship_package(spark)
    spark.dataSource.register(outbox(post))
    sent = journal(spark, path).where("delivered").select("id").distinct()
    once = messages.where("id is not null").groupBy("id").agg(F.min(F.struct("recipient", F.coalesce("message", F.lit("")).alias("message"))).alias("m"))
    # as a table, so that a task that is run again has the same messages
    left = written(once.join(sent, "id", "left_anti").select("id", "m.recipient", "m.message"))
    left.write.format(SOURCE).option("run", run).option("every", str(every)).mode("append").save(path)
