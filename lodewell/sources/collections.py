"""Retrieval collections as Spark data sources: documents, queries and judgements read by file, records written a file each.

`spark.read.format("retrieval")` reads one part of a collection kept as files: documents
as JSON lines, queries as tab-separated lines, judgements as lines of four fields
(query, iteration, document, grade).  `df.write.format("record-files")` writes a JSON file
for each record.  Both work by `pyarrow.fs`, so a path may be any URI that it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

#: The parts of a collection: folder, and columns in the order of their fields.
PARTS = {
    "docs": StructType().add("doc_id", LongType()).add("text", StringType()),
    "queries": StructType().add("query_id", LongType()).add("text", StringType()),
    "qrels": StructType().add("query_id", LongType()).add("doc_id", LongType()).add("rel", IntegerType()),
}
#: Bytes of a file that one task reads; a longer file is read by several.
SPLIT = 32 << 20
#: Lines of an Arrow batch.
BATCH = 5000


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, at = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file: the lines that begin from `start` and before `stop`."""

    path: str
    start: int
    stop: int


class RetrievalReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, part: str):
        self.names, self.path, self.part = schema.names, f"{path.rstrip('/')}/{part}", part
        self.arrow = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema.fields])

    def partitions(self) -> list[Stretch]:
        _, files = _files(self.path)
        return [Stretch(f.path, at, min(f.size, at + SPLIT)) for f in files for at in range(0, f.size, SPLIT)]

    def _lines(self, p: Stretch) -> Iterator[bytes]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(p.path) as f:
            f.seek(max(0, p.start - 1))
            if p.start and f.read(1) != b"\n":  # a line that began before is the stretch before's
                while (c := f.read(1 << 16)) and b"\n" not in c:
                    pass
                f.seek(f.tell() - len(c) + c.index(b"\n") + 1 if c else f.tell())
            at, rest = f.tell(), b""
            while at < p.stop:
                c = f.read(1 << 20)
                if not c:
                    break
                lines = (rest + c).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= p.stop:
                        return
                    at += len(line) + 1
                    yield line
            while at < p.stop and rest and (c := f.read(1 << 20)):
                head, found, _ = c.partition(b"\n")
                rest += head
                if found:
                    break
            if at < p.stop and rest:
                yield rest

    def _record(self, line: bytes) -> dict:
        if self.part == "docs":
            return json.loads(line)
        text = line.decode()
        if self.part == "queries":
            query, _, rest = text.partition("\t")
            return {"query_id": int(query), "text": rest}
        query, _, doc, rel = text.split()
        return {"query_id": int(query), "doc_id": int(doc), "rel": int(rel)}

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no stretches
            return
        held: list[dict] = []
        for line in self._lines(partition):
            if line.strip():
                r = self._record(line)
                held.append({n: r.get(n) for n in self.names})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=self.arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.arrow)


class Retrieval(DataSource):
    """Options: `path`, `part` (docs, queries or qrels), and `columns`, those that are wanted, by commas.

    Blank lines are passed over; a line that isn't of the part's form fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "retrieval"

    def _part(self) -> str:
        part = self.options.get("part", "docs")
        if part not in PARTS:
            raise ValueError(f"part is one of {', '.join(PARTS)}, not {part}")
        return part

    def schema(self) -> StructType:
        whole = PARTS[self._part()]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in wanted]) if wanted else whole

    def reader(self, schema: StructType) -> RetrievalReader:
        return RetrievalReader(schema, self.options["path"], self._part())


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its files, and how many there are."""

    listed: str
    n: int


class RecordWriter(DataSourceWriter):
    """A file takes its name from its record alone, and appears whole or not at all: a task that is run again writes the same files."""

    def __init__(self, path: str, key: str, folders: list[str]):
        self.path, self.key, self.folders = path.rstrip("/"), key, folders
        self.job = uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = self._at()
        made, seen = [], set()
        task = uuid.uuid4().hex
        for row in iterator:
            r = row.asDict(recursive=True)
            if r.get(self.key) is None:
                raise ValueError(f"a record without {self.key} has no name")
            folder = "/".join([root, *(f"{c}={quote(str(r[c]), safe='')}" for c in self.folders)])
            if folder not in seen:
                system.create_dir(folder, recursive=True)
                seen.add(folder)
            name = f"{folder}/{quote(str(r[self.key]), safe='')}.json"
            part = f"{folder}/_{task}"
            with system.open_output_stream(part) as out:
                out.write(json.dumps({k: v for k, v in r.items() if k not in self.folders}, default=str, sort_keys=True).encode())
            system.move(part, name)
            made.append(name)
        system.create_dir(f"{root}/_jobs/{self.job}", recursive=True)
        listed = f"{root}/_jobs/{self.job}/{task}"
        with system.open_output_stream(listed) as out:
            out.write("\n".join(made).encode())
        return Written(listed, len(made))

    def _done(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_jobs/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_jobs/{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._at()
        self._done(system, root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.n for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that finished tasks have listed go again."""
        system, root = self._at()
        for m in messages:
            if m and system.get_file_info(m.listed).type == fs.FileType.File:
                with system.open_input_stream(m.listed) as listed:
                    for name in listed.read().decode().split("\n"):
                        if name and system.get_file_info(name).type == fs.FileType.File:
                            system.delete_file(name)
        self._done(system, root)


class RecordFiles(DataSource):
    """Options: `path`, `key` (the column that names a file; unique), `folders` (columns that are folders, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "record-files"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        folders = [c.strip() for c in self.options.get("folders", "").split(",") if c.strip()]
        missing = [c for c in (self.options.get("key", ""), *folders) if c not in schema.names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        if overwrite:
            system, root = fs.FileSystem.from_uri(self.options["path"])
            if system.get_file_info(root).type == fs.FileType.Directory:
                system.delete_dir_contents(root)
        return RecordWriter(self.options["path"], self.options["key"], folders)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Retrieval)
    spark.dataSource.register(RecordFiles)
