"""Python data sources: prediction bodies by match, read with pruned partitions, and an audit log that is appended once.

    register(spark)
    spark.read.format("prediction_bodies").load(path).filter("match_id = 7")
    rows.write.format("audit_log").option("batch", "2024-01-01").mode("append").save(path)

Paths may carry a scheme that Arrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

BODIES = "match_id long, frame_seq long, det_ord long, class_id long, x double, y double, width double, height double, confidence double"
NUMBERS = ("x", "y", "width", "height", "confidence")
FIELDS = pa.schema([(c, pa.float64() if c in NUMBERS else pa.int64()) for c in (c.split()[0] for c in BODIES.split(", "))])
AUDIT = "id long, at long, action string"
#: Bytes of body files that a task reads, unless a single file has more.
PART_BYTES = 32 << 20
#: Folders among which written() deals matches, and lines in a file at most: files grow with the bodies, not with the matches.
GROUPS, FILE_LINES = 256, 20_000
#: Rows that a task hands to Spark at once.
BATCH_ROWS = 20_000


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    files: tuple[tuple[int, str], ...]


#: What a pushed filter on match_id says of a folder's match.
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _lines(data, size: int = 8 << 20) -> Iterator[bytes]:
    held = b""
    while chunk := data.read(size):
        pieces = (held + chunk).splitlines(keepends=True)
        held = b"" if pieces[-1].endswith((b"\n", b"\r")) else pieces.pop()
        yield from pieces
    if held:
        yield held


class BodyReader(DataSourceReader):
    """Files of lines {"frame_seq": …, "predictions": […]}; a task has some of the files.

    They lie in folders match_id=<id>, or, with a match_id in each line, in folders match_group=<id mod n>-of-<n>. Filters
    on match_id choose the folders, so that files of other matches or groups are never opened. A line that is no body
    has no rows; a body without predictions has one row of nulls but for match and frame.
    """

    def __init__(self, path: str):
        self.path, self.tests, self.asked = path, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("match_id",):
                self.tests.append((TESTS[type(f)], f.value))
                if type(f) in (EqualTo, In):
                    self.asked.append([v for v in (f.value if type(f) is In else [f.value]) if v is not None])
            else:
                yield f

    def _wanted(self, match: int | None) -> bool:
        return not self.tests or match is not None and all(test(match, value) for test, value in self.tests)

    def partitions(self) -> list[Part]:
        store, root = _files(self.path)
        parts, held, size = [], [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            kind, _, value = next((x for x in info.path.split("/") if x.startswith(("match_id=", "match_group="))), "").partition("=")
            name = info.path.rpartition("/")[2]
            if info.type != fs.FileType.File or not kind or name.startswith(("_", ".")):
                continue
            match = int(value) if kind == "match_id" else None  # None: each line tells it
            if match is None:
                group, _, of = value.partition("-of-")
                wanted = all(any(v % int(of) == int(group) for v in values) for values in self.asked)
            else:
                wanted = self._wanted(match)
            if not wanted:
                continue
            if held and size + info.size > PART_BYTES:
                parts.append(Part(tuple(held)))
                held, size = [], 0
            held.append((match, info.path))
            size += info.size
        return [*parts, Part(tuple(held))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _files(self.path)
        rows: list[list] = [[] for _ in FIELDS]
        for folder, path in partition.files:
            with store.open_input_stream(path) as data:
                for line in _lines(data):
                    try:
                        body = json.loads(line)
                        seq, found = body["frame_seq"], body.get("predictions") or []
                        match = body.get("match_id") if folder is None else folder
                    except (ValueError, KeyError, TypeError, AttributeError):
                        continue
                    if folder is None and not self._wanted(match):
                        continue
                    n = len(found) or 1
                    for column, values in zip(rows, ([match] * n, [seq] * n, range(n) if found else [None], [p.get("class_id") for p in found or [{}]])):
                        column += values
                    for column, c in zip(rows[4:], NUMBERS):
                        column += [None if (v := p.get(c)) is None else float(v) for p in found or [{}]]
                    if len(rows[0]) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows = [[] for _ in FIELDS]
        if rows[0]:
            yield _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(rows, FIELDS)], schema=FIELDS)


def written(found: DataFrame, path: str) -> None:
    """Write bodies (match_id, frame_seq, predictions) as lines for BodyReader, in GROUPS folders at most."""
    group = F.concat(F.coalesce(F.pmod("match_id", F.lit(GROUPS)), F.lit(0)).cast("string"), F.lit(f"-of-{GROUPS}"))
    dealt = found.withColumn("match_group", group).repartition("match_group")
    lines = dealt.select("match_group", F.to_json(F.struct("match_id", "frame_seq", "predictions")).alias("value"))
    lines.write.partitionBy("match_group").option("maxRecordsPerFile", FILE_LINES).text(path)


class PredictionBodies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prediction_bodies"

    def schema(self) -> str:
        return BODIES

    def reader(self, schema) -> BodyReader:
        return BodyReader(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class AuditWriter(DataSourceWriter):
    """Tasks write files that nobody reads; the commit names those that count, in one file for the batch.

    A task that fails and runs again, or runs twice at once, leaves files that no commit names. A batch that has been
    committed before is not committed again, so that a job may be repeated with its batch's name.
    """

    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, iterator) -> Written:
        store, root = _files(self.path)
        lines = [json.dumps(row.asDict()) for row in iterator]
        if not lines:
            return Written(None, 0)
        name = f"{root}/rows/{uuid.uuid4().hex}.jsonl"
        store.create_dir(f"{root}/rows")
        with store.open_output_stream(name) as out:
            out.write("\n".join(lines).encode())
        return Written(name.rpartition("/")[2], len(lines))

    def commit(self, messages: list) -> None:
        store, root = _files(self.path)
        done = f"{root}/commits/{self.batch}.json"
        if store.get_file_info(done).type == fs.FileType.File:
            return self.abort(messages)
        store.create_dir(f"{root}/commits")
        with store.open_output_stream(f"{done}.part") as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        store.move(f"{done}.part", done)

    def abort(self, messages: list) -> None:
        store, root = _files(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/rows/{m.file}")


class AuditReader(DataSourceReader):
    """The rows of all committed batches, a task for each file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        store, root = _files(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        names = []
        for info in found:
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as data:
                    names += json.loads(data.read())
        return [Part(((0, f"{root}/rows/{n}"),)) for n in names] or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _files(self.path)
        for _, path in partition.files:
            with store.open_input_stream(path) as data:
                for line in data.read().splitlines():
                    row = json.loads(line)
                    yield row["id"], row["at"], row["action"]


class AuditLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def schema(self) -> str:
        return AUDIT

    def reader(self, schema) -> AuditReader:
        return AuditReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> AuditWriter:
        if overwrite:
            raise ValueError("an audit log is only appended to")
        return AuditWriter(self.options["path"], self.options["batch"])


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it push filters to them, without which it can't read bodies."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PredictionBodies)
    spark.dataSource.register(AuditLog)
