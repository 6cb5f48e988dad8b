"""Dense vectors and their ids as pairs of NumPy files, read and written by tasks.

`df.write.format("npy-vectors")` writes `<name>.ids.npy` and `<name>.vectors.npy`, whole
numbers and rows of floats in the same order; `spark.read.format("npy-vectors")` reads any
folder of such pairs, other tools' too, in stretches of rows.  Only the columns asked for
are read.  Both work by `pyarrow.fs`.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

WHOLE = StructType().add("vec_id", LongType()).add("embedding", ArrayType(FloatType()))
IDS, VECTORS = ".ids.npy", ".vectors.npy"
#: Bytes of vectors that a task reads, and that a pair of files holds.
SPLIT = 32 << 20
FILE = 128 << 20
#: Vectors of an Arrow batch.
BATCH = 5000


def header(system: fs.FileSystem, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, bytes before the first number) of a NumPy file in rows."""
    with system.open_input_file(path) as f:
        head = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = npy.read_magic(head)
    shape, columns, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(head)
    if columns and len(shape) > 1:
        raise ValueError(f"{path} is laid out in columns")
    return shape, kind, head.tell()


def rows_of(system: fs.FileSystem, path: str, start: int, stop: int) -> np.ndarray:
    shape, kind, at = header(system, path)
    width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    with system.open_input_file(path) as f:
        f.seek(at + start * width)
        data = f.read((stop - start) * width)
    if len(data) != (stop - start) * width:
        raise ValueError(f"{path} ends before row {stop}")
    return np.frombuffer(data, kind).reshape(stop - start, *shape[1:])


@dataclass
class Rows(InputPartition):
    """Rows of a pair of files, whose path has no ending."""

    stem: str
    start: int
    stop: int


class VectorReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path = schema.names, path

    def partitions(self) -> list[Rows]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for f in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.endswith(VECTORS) or f.base_name.startswith(("_", ".")):
                continue
            stem = f.path[: -len(VECTORS)]
            shape, kind, _ = header(system, f.path)
            ids, _, _ = header(system, stem + IDS)
            if len(shape) != 2 or ids != shape[:1]:
                raise ValueError(f"{f.path} has shape {shape}, its ids {ids}")
            step = max(1, SPLIT // max(1, shape[1] * kind.itemsize))
            found += [Rows(stem, at, min(shape[0], at + step)) for at in range(0, shape[0], step)]
        return found

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no stretches
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        for at in range(partition.start, partition.stop, BATCH):
            end = min(partition.stop, at + BATCH)
            columns = []
            for name in self.names:
                if name == "vec_id":
                    columns.append(pa.array(rows_of(system, partition.stem + IDS, at, end).astype(np.int64)))
                else:
                    v = rows_of(system, partition.stem + VECTORS, at, end).astype(np.float32)
                    offsets = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.reshape(-1))))
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


@dataclass
class Pairs(WriterCommitMessage):
    """The pairs of files that a task has written, without endings."""

    stems: list[str]


class VectorWriter(DataSourceArrowWriter):
    """Tasks write hidden files, which the commit names; a task that is run again leaves nothing that is read."""

    def __init__(self, path: str, key: str, vector: str):
        self.path, self.key, self.vector = path.rstrip("/"), key, vector

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pairs:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        stems: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        width = None

        def close() -> None:
            stem = f"{root}/_{uuid.uuid4().hex}"
            for ending, parts in ((IDS, [i for i, _ in held]), (VECTORS, [v for _, v in held])):
                with system.open_output_stream(stem + ending) as out:
                    whole = np.concatenate(parts)
                    npy.write_array_header_1_0(out, npy.header_data_from_array_1_0(whole))
                    out.write(whole.tobytes())
            stems.append(stem)
            held.clear()

        for b in iterator:
            if not b.num_rows:
                continue
            ids, lists = b.column(b.schema.get_field_index(self.key)), b.column(b.schema.get_field_index(self.vector))
            flat = lists.flatten()
            if ids.null_count or lists.null_count or flat.null_count:
                raise ValueError("an id, a vector or a number of one is null")
            v = flat.to_numpy(zero_copy_only=False).astype("<f4")
            widths = np.unique(np.diff(lists.offsets.to_numpy()))
            width = int(widths[0]) if width is None else width
            if len(widths) != 1 or widths[0] != width:
                raise ValueError("vectors of one length are needed")
            held.append((ids.to_numpy(zero_copy_only=False).astype("<i8"), v.reshape(b.num_rows, width)))
            if sum(x.nbytes for _, x in held) >= FILE:
                close()
        if held:
            close()
        return Pairs(stems)

    def commit(self, messages: list[Pairs | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for stem in (s for m in messages if m for s in m.stems):
            folder, _, name = stem.rpartition("/")
            for ending in (IDS, VECTORS):
                system.move(stem + ending, f"{folder}/{name[1:]}{ending}")
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Pairs | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in (s + ending for m in messages if m for s in m.stems for ending in (IDS, VECTORS)):
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)


class NpyVectors(DataSource):
    """Options: `path`; reading, `columns` (of vec_id and embedding, by commas); writing, `key` and `vector` (columns, those two if not given).

    Vectors of all files need not have one length to be read; those that a task writes
    do.  Null ids, vectors or numbers fail the write; an empty table leaves no files.
    """

    @classmethod
    def name(cls) -> str:
        return "npy-vectors"

    def schema(self) -> StructType:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([WHOLE[c] for c in wanted]) if wanted else WHOLE

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        key, vector = self.options.get("key", "vec_id"), self.options.get("vector", "embedding")
        missing = [c for c in (key, vector) if c not in schema.names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        if overwrite:
            system, root = fs.FileSystem.from_uri(self.options["path"])
            if system.get_file_info(root).type == fs.FileType.Directory:
                system.delete_dir_contents(root)
        return VectorWriter(self.options["path"], key, vector)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyVectors)
