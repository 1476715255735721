"""``spark.read.format("pdf")`` and ``df.write.format("pdf")``: relations of files, and files of rows.

    spark.dataSource.register(PdfSource)
    spark.read.format("pdf").option("relation", "pages").load("file:///in")
    df.select("name", "content").write.format("pdf").mode("append").save("file:///out")

Reading: the relations of ``quire.sources.pdf`` and ``catalog`` by name, with the file's path before
their columns and, where a file can't be read to its end, a row that says why. Files are
listed once, in the planner, and dealt to tasks by their bytes; a file is opened by the
task that reads it and gives all of its rows or an error row.

Writing: rows of (name, content), content as bytes or text, one file each. A task attempt writes into
a folder of its own beside the table and only reports the folder. The commit moves the
folders of the attempts that Spark took, so a repeated, speculative or failed
attempt leaves no file that a reader sees, and an aborted job none at all.

Paths are those of ``pyarrow.fs``: local ones and file, hdfs, s3, gs and abfs URIs.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quire.sources import catalog, pdf

#: What ``relation`` may say: relation -> the function that has its rows.
RELATIONS = {f.__name__: f for f in (pdf.documents, pdf.objects, pdf.references, pdf.pages, pdf.operators, pdf.runs, pdf.painted, pdf.sections, pdf.linearization, catalog.info, catalog.bookmarks, catalog.annotations, catalog.fields, catalog.label_ranges, catalog.attachments, catalog.structure, catalog.signatures)}
#: Bytes of files that a task reads, about (option ``bytesPerTask``), and what each file counts for besides.
BYTES, OPENING = 32 << 20, 1 << 20
#: Where attempts write until they are committed; readers pass by names that begin so.
PENDING = "_pending"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))


def safe_name(name: str | None) -> str:
    """A file name that can't lead out of its folder; raises for all others.

    Separators of either kind, drive letters, ``..`` and ``.``, control characters and
    names that readers pass by (leading ``_`` or ``.``) are refused, not repaired: two
    names must not become one.
    """
    if not name or name[0] in "._" or any(c in "/\\:" or ord(c) < 32 or ord(c) == 127 for c in name) or len(name.encode()) > 255:
        raise ValueError(f"no safe file name: {name!r}")
    return name


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def _relation(self) -> pdf.Rows:
        which = self.options.get("relation", "documents")
        if which not in RELATIONS:
            raise ValueError(f"relation must be one of {', '.join(RELATIONS)}")
        return pdf.Rows(RELATIONS[which])

    def schema(self) -> str:
        said = self._relation().schema
        return f"path string, {said}" + ("" if "error string" in said else ", error string")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema, self._relation())

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType, relation: pdf.Rows):
        self.path, self.schema, self.relation = options["path"], schema, relation
        self.pattern, self.bytes = options.get("pathGlobFilter", "*"), int(options.get("bytesPerTask", BYTES))

    def partitions(self) -> list[Files]:
        """Files in the order of their size, each to the task with the fewest bytes so far."""
        import heapq

        system, root = opened(self.path)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in ("_", ".") for x in posixpath.relpath(p, root).split("/") if x != ".")
        files = [f for f in found if f.type == fs.FileType.File and (f.path == root or not hidden(f.path)) and fnmatch.fnmatch(f.base_name, self.pattern)]
        tasks = min(len(files), -(-sum(f.size + OPENING for f in files) // self.bytes))
        room: list[tuple[int, int]] = [(0, k) for k in range(tasks)]
        held: list[list[str]] = [[] for _ in range(tasks)]
        for f in sorted(files, key=lambda f: (-f.size, f.path)):
            size, k = heapq.heappop(room)
            held[k].append(f.path)
            heapq.heappush(room, (size + f.size + OPENING, k))
        return [Files(sorted(p)) for p in held]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        system, _ = opened(self.path)
        arrow, wide = to_arrow_schema(self.schema), len(self.schema.fields) - 1
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                data = file.read()
            try:
                rows: list[tuple[Any, ...]] = [(path, *r, *[None] * (wide - len(r))) for r in self.relation.rows(data)]
            except pdf.BROKEN as e:
                rows = [(path, *[None] * (wide - 1), f"{type(e).__name__}: {e}"[:200])]
            for at in range(0, len(rows), pdf.ROWS):
                yield pdf._batch(rows[at : at + pdf.ROWS], arrow)


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


class Writer(DataSourceWriter):
    """``overwrite`` takes out what the folder held when the job commits, not before."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        kinds = [(f.name, f.dataType) for f in schema.fields]
        if [n for n, _ in kinds] != ["name", "content"] or not isinstance(kinds[0][1], T.StringType) or not isinstance(kinds[1][1], (T.StringType, T.BinaryType)):
            raise ValueError("rows of (name string, content binary or string) are written")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/{PENDING}-{self.job}"

    def write(self, iterator: Iterator[Any]) -> Written:
        system, root = opened(self.path)
        folder, names = f"{self._pending(root)}/part-{uuid.uuid4().hex}", set()
        for row in iterator:
            name = safe_name(row["name"])
            if name in names:
                raise ValueError(f"two files are called {name!r}")
            if row["content"] is None:
                raise ValueError(f"{name!r} has no content")
            if not names:
                system.create_dir(folder, recursive=True)
            names.add(name)
            with system.open_output_stream(f"{folder}/{name}") as file:
                file.write(row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"]))
        return Written(folder if names else None, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        """A move for each task, whatever the number of files; tasks' folders keep their names apart."""
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if not old.base_name.startswith(PENDING):
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{root}/{posixpath.basename(m.folder)}")
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS") as file:
            file.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(root))
