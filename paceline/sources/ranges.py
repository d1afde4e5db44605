"""Partitioned readers of large single files: nested truth in JSON and arrays in NPZ, as Python data sources.

A file is planned as ranges of bytes.  A range of a truth file begins at the first frame key
in it and ends with the frame whose key is its last, so frames are read once and a task
holds one frame.  A range of an NPZ file is a slice of its rows: members that are stored
are sought, compressed ones are streamed up to the slice.  Files have to be in a store that
pyarrow's file systems open; ``files`` reads others whole.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 64 << 20
CHUNK = 4 << 20


def _open(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else uri)
    return store.open_input_file(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """(address, bytes) of the files of ``path``, as Spark lists them; None if pyarrow can't open their store."""
    found = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    try:
        for uri, _ in found[:1]:
            _open(uri).close()
    except (OSError, ValueError, NotImplementedError):
        return None
    return found


@dataclass
class Range(InputPartition):
    uri: str
    part: int
    parts: int
    size: int

    @property
    def bytes(self) -> tuple[int, int]:
        return self.size * self.part // self.parts, self.size * (self.part + 1) // self.parts


class _Ranges(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri, size in self.files:
            parts = max(1, -(-size // self.part_bytes))
            out += [Range(uri, k, parts, size) for k in range(parts)]
        return out


#: A frame: digits, then an array of objects. Within a frame no key of digits has one, and quotes in strings are escaped.
KEY = re.compile(rb'"(\d+)"\s*:\s*(\[)\s*\{')


def frames_in(read, size: int, lo: int, hi: int, wanted) -> Iterator[tuple[int, list]]:
    """(number, objects) of the ``wanted`` frames whose keys begin in bytes lo to hi. read: (offset, length) -> bytes."""
    base, buf, at = lo, b"", 0
    open_ = None  # the frame that is being read: number and where its array begins
    decode = json.JSONDecoder().raw_decode

    while True:
        m = KEY.search(buf, at)
        end = base + len(buf) >= size
        if m is None and not end:
            # A key that the buffer cuts off begins within its last 4 KB; an open frame is kept whole.
            keep = open_[1] if open_ else max(0, len(buf) - 4096)
            at = max(at, len(buf) - 4096) - keep
            buf, base = buf[keep:] + read(base + len(buf), CHUNK), base + keep
            at = max(at, 0)
            open_ = open_ and (open_[0], 0)
            continue
        if open_:
            yield open_[0], decode(buf[open_[1] : m.start() if m else len(buf)].decode("utf-8", "replace"))[0]
            open_ = None
        if m is None or base + m.start() >= hi:
            return
        frame = int(m[1])
        open_ = (frame, m.start(2)) if wanted(frame) else None
        at = m.end()


class TruthReader(_Ranges):
    def __init__(self, options: dict):
        super().__init__(options)
        self.stride = int(options.get("stride", 1))
        self.cameras = set(json.loads(options["cameras"])) if options.get("cameras") else None
        self.kind = options.get("kind", "Person")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("frame", pa.int64()), ("cam_id", pa.int32()), ("person_id", pa.int64()), *((c, pa.float64()) for c in ("left", "top", "width", "height"))])
        rows: list[tuple] = []
        with _open(partition.uri) as f:
            size = f.size()
            lo, hi = size * partition.part // partition.parts, size * (partition.part + 1) // partition.parts
            for frame, objects in frames_in(lambda at, n: f.read_at(min(n, size - at), at), size, lo, hi, lambda x: x % self.stride == 0):
                for o in objects:
                    if o.get("object type") != self.kind:
                        continue
                    for name, b in (o.get("2d bounding box visible") or {}).items():
                        number = re.search(r"(\d+)$", name)
                        cam = int(number[1]) if number else None
                        if (self.cameras is None or cam in self.cameras) and b[2] > b[0] and b[3] > b[1]:
                            rows.append((frame, cam, o.get("object id"), float(b[0]), float(b[1]), float(b[2] - b[0]), float(b[3] - b[1])))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class TruthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paceline_truth"

    def schema(self) -> str:
        return "frame long, cam_id int, person_id long, left double, top double, width double, height double"

    def reader(self, schema) -> DataSourceReader:
        return TruthReader(dict(self.options))


def _member_rows(z: zipfile.ZipFile, raw: pa.NativeFile, name: str, part: int, parts: int) -> tuple[int, Iterator[np.ndarray]]:
    """(rows of the whole array, blocks of the rows of a part) of one member."""
    info = z.getinfo(f"{name}.npy")
    f = z.open(info)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject or not shape:
        raise ValueError("arrays of objects and scalars are not read")
    if fortran and len(shape) > 1:
        whole = np.frombuffer(f.read(), kind).reshape(shape, order="F")
        return shape[0], iter([whole[shape[0] * part // parts : shape[0] * (part + 1) // parts]])
    row = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    lo, hi = shape[0] * part // parts, shape[0] * (part + 1) // parts
    per = max(1, CHUNK // max(1, row))

    def blocks() -> Iterator[np.ndarray]:
        if info.compress_type == zipfile.ZIP_STORED:
            head = raw.read_at(30, info.header_offset)
            start = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little") + f.tell()
            get = lambda a, b: raw.read_at((b - a) * row, start + a * row)
        else:
            left = lo * row
            while left:
                left -= len(f.read(min(left, CHUNK)))
            get = lambda a, b: f.read((b - a) * row)
        for a in range(lo, hi, per):
            b = min(a + per, hi)
            yield np.frombuffer(get(a, b), kind).reshape(b - a, *shape[1:])

    return shape[0], blocks()


class NpzReader(_Ranges):
    def __init__(self, options: dict, schema):
        super().__init__(options)
        self.columns = [f.name for f in schema.fields]
        self.types = pa.schema([(f.name, _arrow_type(f.dataType.simpleString())) for f in schema.fields])
        self.names = json.loads(options.get("names", "{}"))
        self.normalise = options.get("normalise") == "true"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        try:
            with _open(partition.uri) as raw, zipfile.ZipFile(raw) as z:
                found = [_member_rows(z, raw, self.names.get(c, c), partition.part, partition.parts) for c in self.columns]
                if len({n for n, _ in found}) > 1:
                    return
                yield from self._batches([b for _, b in found])
        except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile):
            return  # unreadable files give no rows

    def _batches(self, members: list[Iterator[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [None] * len(members)
        while True:
            for k, blocks in enumerate(members):
                if held[k] is None or not len(held[k]):
                    held[k] = next(blocks, None)
            if any(h is None for h in held):
                return
            n = min(len(h) for h in held)
            yield pa.RecordBatch.from_arrays([self._column(c, h[:n]) for c, h in zip(self.types, held, strict=True)], schema=self.types)
            held = [h[n:] for h in held]

    def _column(self, of: pa.Field, a: np.ndarray) -> pa.Array:
        if a.ndim == 1:
            return pa.array(a).cast(of.type)
        a = a.astype(float)
        if self.normalise and of.name == "embedding":
            n = np.linalg.norm(a, axis=1, keepdims=True)
            a = a / np.where(n > 0, n, 1)
        return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel())).cast(of.type)


def _arrow_type(spark_type: str) -> pa.DataType:
    if spark_type.startswith("array<"):
        return pa.list_(_arrow_type(spark_type[6:-1]))
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "string": pa.string()}[spark_type]


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paceline_npz"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(dict(self.options), schema)


def _load(spark: SparkSession, source: type[DataSource], files: list[tuple[str, int]], schema: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(files=json.dumps(files), **options)
    return (reader.schema(schema) if schema else reader).load()


def truth(spark: SparkSession, files: list[tuple[str, int]], stride: int, cameras: list[int] | None, part_bytes: int) -> DataFrame:
    return _load(spark, TruthSource, files, stride=str(stride), cameras=json.dumps(cameras) if cameras is not None else "", part_bytes=str(part_bytes))


def npz(spark: SparkSession, files: list[tuple[str, int]], schema: str, names: dict[str, str], normalise: bool, part_bytes: int) -> DataFrame:
    return _load(spark, NpzSource, files, schema, names=json.dumps(names), normalise=str(normalise).lower(), part_bytes=str(part_bytes))
