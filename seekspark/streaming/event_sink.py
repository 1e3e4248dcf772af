"""A sink for ordered events: each batch becomes visible as a whole, once, by its manifest.

Tasks write JSON lines under staged/ and report them; the driver puts the names of a batch's files into
one manifest, whose file name is the batch. A batch that is run again finds its manifest and drops the new
files. Files that no manifest names were left by tasks that failed, and are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

NAME = "seekspark-events"


def _at(path: str):
    """The file system of a path (local, or any that Arrow knows) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


class EventWriter(DataSourceStreamWriter):
    def __init__(self, schema: StructType, path: str) -> None:
        self.fields, self.path = schema.fieldNames(), path

    def write(self, iterator: Iterator[Row]) -> Staged:
        """A task's rows, in their order, in a file of its own; if the task fails the file goes."""
        store, root = _at(self.path)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        store.create_dir(f"{root}/staged", recursive=True)
        try:
            with store.open_output_stream(f"{root}/staged/{name}") as out:
                for rows, row in enumerate(iterator, 1):
                    out.write(json.dumps(dict(zip(self.fields, row, strict=True)), ensure_ascii=False, default=str).encode() + b"\n")
        except BaseException:
            store.delete_file(f"{root}/staged/{name}")
            raise
        return Staged(name, rows)

    def _drop(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = _at(self.path)
        for m in messages:
            at = f"{root}/staged/{m.name}" if m is not None else None
            if at and store.get_file_info(at).type != fs.FileType.NotFound:
                store.delete_file(at)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        from pyarrow import fs

        store, root = _at(self.path)
        manifest = f"{root}/batches/{batchId:012d}.json"
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        store.create_dir(f"{root}/batches", recursive=True)
        hidden = f"{root}/batches/.{batchId}-{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps({"batch": batchId, "files": [m.name for m in messages if m is not None], "rows": sum(m.rows for m in messages if m is not None)}).encode())
        store.move(hidden, manifest)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._drop(messages)


class EventSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:
        return EventWriter(schema, self.options["path"])


def event_stream(events: DataFrame, path: str, checkpoint: str):
    """A writer of a stream of events to path; start it with the trigger that is wanted."""
    spark = events.sparkSession
    spark.dataSource.register(EventSink)
    return events.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_events(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The events of all committed batches, with the batch of each. Rows of files that no manifest names aren't read as events."""
    manifests = spark.read.schema("batch long, files array<string>, rows long").json(f"{path}/batches")
    named = manifests.select("batch", F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).json(f"{path}/staged").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(named, "_file").drop("_file")
