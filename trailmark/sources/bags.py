"""Recorded message bags (format 2.0) as a data source: spark.read.format("bag").option("path", ...).option("topic", ...).

A bag is chunks of messages and, at its end, an index: which chunks there are, their first and last times and how many
messages of each connection they hold. The index alone decides which chunks are read: each that may hold the topic within
the wanted times is one partition, and no other is opened. Times are pushed down from filters on `stamp`, the time of
recording; a filter on a message's own time is Spark's.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed: the first line, and the kinds of records.
MAGIC = b"#ROSBAG V2.0\n"
HEAD, CHUNK, CONNECTION, MESSAGE, INDEX, CHUNK_INFO = 0x03, 0x05, 0x07, 0x02, 0x04, 0x06
#: Columns of each kind of message, after stamp (time of recording, seconds) and topic.
SCHEMAS = {
    "imu": "t double, ax double, ay double, az double, gx double, gy double, gz double",
    "pose": "t double, x double, y double, z double, qx double, qy double, qz double, qw double",
    "events": "t double, x int, y int, p int",
    "image": "t double, height int, width int, encoding string, pixels binary",
    "raw": "message_type string, data binary",
}
#: Rows of a batch at least, if there are as many.
BATCH = 8192


@dataclass(frozen=True)
class Chunk(InputPartition):
    """A chunk of a bag, the connections of the wanted topic, and the closed window of recording times in nanoseconds."""

    path: str
    at: int
    connections: tuple[tuple[int, str, str], ...]
    low: int
    high: int


def open_at(path: str):
    """A seekable file from any store that Arrow knows."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def fields(header: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(header):
        size = struct.unpack_from("<I", header, at)[0]
        name, _, value = header[at + 4 : at + 4 + size].partition(b"=")
        out[name.decode()] = value
        at += 4 + size
    return out


def number(value: bytes) -> int:
    return int.from_bytes(value, "little")


def nanoseconds(value: bytes) -> int:
    seconds, rest = struct.unpack("<II", value)
    return seconds * 1_000_000_000 + rest


def record(stream) -> tuple[dict[str, bytes], bytes]:
    """The next record's header fields and data."""
    sizes = stream.read(4)
    if len(sizes) < 4:
        raise ValueError("the bag ends within a record")
    head = fields(bytes(stream.read(number(sizes))))
    return head, bytes(stream.read(number(stream.read(4))))


def records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    at = 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at)[0]
        head, at = fields(data[at + 4 : at + 4 + size]), at + 4 + size
        size = struct.unpack_from("<I", data, at)[0]
        yield head, data[at + 4 : at + 4 + size]
        at += 4 + size


@dataclass(frozen=True)
class BagIndex:
    """connections: number -> topic and message type; chunks: place, first and last time, connections' message counts."""

    connections: dict[int, tuple[str, str]]
    chunks: list[tuple[int, int, int, dict[int, int]]]


def read_index(path: str) -> BagIndex:
    """The index at a bag's end; no chunk is read."""
    with open_at(path) as stream:
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no bag of format 2.0")
        head, _ = record(stream)
        if number(head["op"]) != HEAD or not number(head["index_pos"]):
            raise ValueError(f"{path} has no index; reindex it first")
        stream.seek(number(head["index_pos"]))
        connections, chunks = {}, []
        for _ in range(number(head["conn_count"])):
            own, data = record(stream)
            connections[number(own["conn"])] = (own["topic"].decode(), fields(data)["type"].decode())
        for _ in range(number(head["chunk_count"])):
            own, data = record(stream)
            counts = dict(struct.iter_unpack("<II", data))
            chunks.append((number(own["chunk_pos"]), nanoseconds(own["start_time"]), nanoseconds(own["end_time"]), counts))
    return BagIndex(connections, chunks)


def read_chunk(path: str, at: int) -> bytes:
    """A chunk's records, decompressed."""
    with open_at(path) as stream:
        stream.seek(at)
        head, data = record(stream)
    if number(head["op"]) != CHUNK:
        raise ValueError(f"{path} has no chunk at {at}")
    kind = head["compression"].decode()
    if kind not in ("none", "bz2"):
        raise ValueError(f"chunks compressed by {kind} aren't read")
    return bz2.decompress(data) if kind == "bz2" else data


def skip_header(data: bytes) -> tuple[float, int]:
    """A message's own time, and where what follows its header (sequence, time, frame) begins."""
    _, seconds, rest, size = struct.unpack_from("<IIII", data)
    return seconds + rest * 1e-9, 16 + size


def decode(kind: str, data: bytes, message_type: str) -> list[tuple]:
    """Rows of a message, without stamp and topic."""
    if kind == "raw":
        return [(message_type, data)]
    t, at = skip_header(data)
    if kind == "imu":  # orientation and its covariance, then angular velocity, then acceleration
        gyro, accel = struct.unpack_from("<3d", data, at + 13 * 8), struct.unpack_from("<3d", data, at + 25 * 8)
        return [(t, *accel, *gyro)]
    if kind == "pose":
        return [(t, *struct.unpack_from("<7d", data, at))]
    if kind == "image":
        height, width, size = struct.unpack_from("<III", data, at)
        encoding = data[at + 12 : at + 12 + size].decode()
        at += 12 + size
        row, many = struct.unpack_from("<xII", data, at)
        return [(t, height, width, encoding, data[at + 9 : at + 9 + many])]
    many = struct.unpack_from("<I", data, at + 8)[0]
    packed = np.frombuffer(data, np.dtype([("x", "<u2"), ("y", "<u2"), ("s", "<u4"), ("n", "<u4"), ("p", "u1")]), many, at + 12)
    times = packed["s"] + packed["n"] * 1e-9
    return list(zip(times.tolist(), packed["x"].tolist(), packed["y"].tolist(), np.where(packed["p"] > 0, 1, -1).tolist(), strict=True))


class BagReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, topic: str | None, schema) -> None:
        self.paths, self.kind, self.topic, self.fields = paths, kind, topic, schema
        self.low, self.high = 0, 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on stamp and one topic; all filters are left to Spark, too, as bounds are in whole nanoseconds."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "stamp" and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.low = max(self.low, int(f.value * 1e9) - 1_000)
            if name == "stamp" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.high = min(self.high, int(f.value * 1e9) + 1_000)
            if name == "topic" and isinstance(f, EqualTo):
                self.topic = f.value if self.topic in (None, f.value) else "\0no topic"
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            index = read_index(path)
            wanted = {k: v for k, v in index.connections.items() if self.topic in (None, v[0])}
            for at, first, last, counts in index.chunks:
                own = tuple((k, *wanted[k]) for k in sorted(counts) if k in wanted and counts[k])
                if own and last >= self.low and first <= self.high:
                    out.append(Chunk(path, at, own, self.low, self.high))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.fields), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        if not isinstance(partition, Chunk):  # no chunk holds anything wanted
            return
        topics = {k: (topic, kind) for k, topic, kind in partition.connections}
        for head, data in records(read_chunk(partition.path, partition.at)):
            if number(head["op"]) != MESSAGE or (own := topics.get(number(head["conn"]))) is None:
                continue
            stamp = nanoseconds(head["time"])
            if partition.low <= stamp <= partition.high:
                rows += [(stamp / 1e9, own[0], *r) for r in decode(self.kind, data, own[1])]
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class BagSource(DataSource):
    """Options: path (several joined by commas), kind (imu, pose, events, image or raw), topic (all that have the kind if
    there is none, so messages of another kind need a topic)."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        kind = self.options.get("kind", "raw")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {sorted(SCHEMAS)}")
        return f"stamp double, topic string, {SCHEMAS[kind]}"

    def reader(self, schema) -> BagReader:
        paths = [p for p in self.options.get("path", "").split(",") if p]
        if not paths:
            raise ValueError("a bag needs a path")
        return BagReader(paths, self.options.get("kind", "raw"), self.options.get("topic"), schema)


def install(spark: SparkSession) -> None:
    """Registers the source for a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)


def read_bag(spark: SparkSession, path: str, kind: str, topic: str, start: float | None = None, end: float | None = None, slack: float = 1.0) -> DataFrame:
    """Rows of one topic with their own time from `start` to `end` seconds after the bag's first message (both closed).

    Chunks are chosen by the time of recording, which may be up to `slack` seconds from a message's own."""
    install(spark)
    rows = spark.read.format("bag").option("path", path).option("kind", kind).option("topic", topic).load()
    first = min((c[1] for c in read_index(path).chunks), default=0) / 1e9 if (start, end) != (None, None) else 0.0
    if start is not None:
        rows = rows.where((F.col("stamp") >= first + start - slack) & (F.col("t") >= first + start))
    if end is not None:
        rows = rows.where((F.col("stamp") <= first + end + slack) & (F.col("t") <= first + end))
    return rows
