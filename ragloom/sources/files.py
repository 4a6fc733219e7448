"""Files as Spark data sources: typed elements and pages of whole folders, in batches and as a stream.

    files.register(spark)
    spark.read.format("file_elements").load("/data/uploads").where("kind = 'Table'")
    spark.read.format("file_pages").option("partitionBytes", 1 << 24).load("s3://bucket/uploads")
    spark.readStream.format("file_elements").load("/data/uploads")

Small files share a partition and a large one has its own, in the order of their paths; a text file beyond
``splitBytes`` is cut at blank lines and read by several tasks.  Files are opened where they are read and never held
whole (see elements).  A schema given by the caller names the columns that are made; filters on the path leave files out
before they are listed into partitions, filters on the kind drop elements before they become rows.

A file that can't be read, or has no reader, gives a single row with its ``error`` and, if it broke midway, the rows
before it; the others go on.  An empty file gives no row, and neither does an empty folder.
Options: path (several with commas), partitionBytes, splitBytes, recursive, extensions (with commas; others are skipped
without an error row).  Paths are local or URIs that pyarrow.fs opens.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ragloom.sources import elements
from ragloom.sources.readers import PARAGRAPHS_A_PAGE

PARTITION_BYTES, SPLIT_BYTES = 64 << 20, 64 << 20
#: Rows, and characters of text, of one Arrow batch.
BATCH_ROWS, BATCH_CHARS = 2000, 4 << 20

FILE = [("path", T.StringType(), pa.string()), ("size", T.LongType(), pa.int64())]
_CELLS = pa.list_(pa.list_(pa.string()))
ELEMENT = [*FILE, ("at", T.LongType(), pa.int64()), ("kind", T.StringType(), pa.string()), ("text", T.StringType(), pa.string()), ("level", T.IntegerType(), pa.int32()), ("page", T.IntegerType(), pa.int32()), ("rows", T.ArrayType(T.ArrayType(T.StringType())), _CELLS), ("error", T.StringType(), pa.string())]
PAGE = [*FILE, ("page", T.IntegerType(), pa.int32()), ("text", T.StringType(), pa.string()), ("error", T.StringType(), pa.string())]


@dataclass(frozen=True)
class Slice:
    """A file, or the part of a text file from ``start`` to ``end``."""

    path: str
    size: int
    start: int = 0
    end: int | None = None


@dataclass(frozen=True)
class Slices(InputPartition):
    slices: tuple[Slice, ...]


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def system_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path within it, and what to put before its own paths."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, at = fs.FileSystem.from_uri(path)
    return system, at, path.partition("://")[0] + "://"


def listed(paths: str, recursive: bool, after: int = -1, until: int | None = None) -> list[tuple[str, int, int]]:
    """path, size and time of change (nanoseconds) of the files under ``paths`` that changed after ``after`` and not after ``until``, by path."""
    found = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, at, prefix = system_of(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such path: {path}")
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=recursive))
        found += [(prefix + i.path, i.size or 0, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted({f for f in found if f[2] > after and (until is None or f[2] <= until)})


def opened(path: str) -> io.BufferedReader:
    """A seekable file, read piece by piece."""
    system, at, _ = system_of(path)
    return io.BufferedReader(system.open_input_file(at), 1 << 16)


def created(path: str) -> pa.NativeFile:
    """A new file, with the folders above it; a task that runs again writes the same file anew."""
    system, at, _ = system_of(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def planned(files: Iterable[tuple[str, int, int]], partition_bytes: int, split_bytes: int, splits: tuple[str, ...]) -> list[Slices]:
    """Files in their order, packed to partitions of about so many bytes; files of the kinds ``splits`` cut to parts."""
    out: list[Slices] = []
    held: list[Slice] = []
    total = 0
    for path, size, _ in files:
        parts = [Slice(path, size)]
        if extension(path) in splits and size > split_bytes:
            parts = [Slice(path, size, a, min(size, a + split_bytes)) for a in range(0, size, split_bytes)]
        for s in parts:
            own = (s.end or s.size) - s.start
            if held and total + own > partition_bytes:
                out.append(Slices(tuple(held)))
                held, total = [], 0
            held.append(s)
            total += own
    return [*out, Slices(tuple(held))] if held else out


def text_lines(file: io.BufferedReader, start: int, end: int) -> Iterator[str]:
    """Lines of the paragraphs that begin between two places: from the first blank line at or after ``start`` to the first at or after ``end``."""
    at = 0
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    started = not start
    for raw in file:
        if not raw.strip():
            if at >= end:
                return
            started = True
        if started:
            yield raw.decode("utf-8-sig" if not at else "utf-8", "replace")
        at += len(raw)


def elements_of(s: Slice) -> Iterator[dict]:
    """``at`` counts elements; in a part of a text file, from the part's first byte on, so that parts follow one another."""
    kind = extension(s.path)
    if kind not in elements.READERS:
        raise ValueError(f"unsupported file type: {kind}")
    with opened(s.path) as file:
        found = elements.text_elements(text_lines(file, s.start, s.end)) if s.end is not None else elements.READERS[kind](file)
        for i, e in enumerate(found):
            yield {"at": s.start + i, **e._asdict()}


def pages_of(s: Slice) -> Iterator[dict]:
    """Slides, runs of PARAGRAPHS_A_PAGE paragraphs of a document, or a text file whole; pages of pictures alone are empty."""
    kind = extension(s.path)
    if kind not in elements.READERS:
        raise ValueError(f"unsupported file type: {kind}")
    with opened(s.path) as file:
        if kind in ("txt", "md", "html", "htm"):
            text = file.read().decode("utf-8-sig", "replace")
            yield from [{"page": 1, "text": text}] if text else []
            return
        page, held = 1, []
        for e in elements.READERS[kind](file):
            if kind == "pptx":
                if e.kind == "PageBreak":
                    yield {"page": page, "text": "\n".join(held)}
                    page, held = page + 1, []
                elif e.text:
                    held.append(e.text)
            elif e.kind not in ("Header", "Footer") and e.text:
                if len(held) == PARAGRAPHS_A_PAGE:
                    yield {"page": page, "text": "\n".join(held)}
                    page, held = page + 1, []
                held.append(e.text)
        if held:
            yield {"page": page, "text": "\n".join(held)}


class _Files:
    """What batch and stream readers share: options, pushed filters, and rows of a partition as Arrow batches."""

    def __init__(self, options: dict, schema: T.StructType, fields: list, rows: Callable[[Slice], Iterator[dict]], splits: tuple[str, ...]):
        kinds = {n: a for n, _, a in fields}
        known = {n: t for n, t, _ in fields}
        for f in schema.fields:
            if f.name not in known or f.dataType != known[f.name]:
                raise ValueError(f"no column {f.name} of type {f.dataType.simpleString()}")
        self.made = pa.schema([(n, kinds[n]) for n in schema.names])
        self.rows, self.splits = rows, splits
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("no path is given")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.partition_bytes, self.split_bytes = int(options.get("partitionBytes", PARTITION_BYTES)), max(1, int(options.get("splitBytes", SPLIT_BYTES)))
        self.extensions = {e.strip().lower() for e in options["extensions"].split(",")} if options.get("extensions") else None
        self.tests: list[Filter] = []
        self.kinds: set[str] | None = None

    def plan(self, after: int = -1, until: int | None = None) -> list[Slices]:
        files = [f for f in listed(self.path, self.recursive, after, until) if self.wanted(f[0])]
        return planned(files, self.partition_bytes, self.split_bytes, self.splits)

    def wanted(self, path: str) -> bool:
        if self.extensions is not None and extension(path) not in self.extensions:
            return False
        says = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
        return all(says[type(t)](t.value) for t in self.tests)

    def pushed(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.tests.append(f)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = own if self.kinds is None else self.kinds & own
            else:
                yield f

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.made], schema=self.made)

    def read(self, partition: Slices | None) -> Iterator[pa.RecordBatch]:
        """Rows of a partition; where no file is left, Spark asks for one that is None."""
        held: list[dict] = []
        chars = 0
        for s in partition.slices if partition else ():
            base = {"path": s.path, "size": s.size}
            found = self.rows(s)
            while True:
                try:
                    row = {**base, **next(found)}
                except StopIteration:
                    break
                except Exception as e:
                    row = {**base, "error": f"{type(e).__name__}: {e}"}
                    found = iter(())
                if self.kinds is not None and row.get("kind") not in self.kinds:
                    continue
                held.append(row)
                chars += len(row.get("text") or "")
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield self.batch(held)
                    held, chars = [], 0
        if held:
            yield self.batch(held)


class FileReader(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.files.pushed(filters))

    def partitions(self) -> Sequence[Slices]:
        return self.files.plan()

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class FileStream(DataSourceStreamReader):
    """New and changed files, by their time of change; one that arrives with an older time than files already seen is not seen."""

    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for _, _, t in listed(self.files.path, self.files.recursive)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Slices]:
        return self.files.plan(start["changed"], end["changed"])

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class ElementSource(DataSource):
    """path, size, at, kind, text, level, page, rows and error of every element."""

    fields, rows, splits = ELEMENT, staticmethod(elements_of), ("txt",)

    @classmethod
    def name(cls) -> str:
        return "file_elements"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t, _ in self.fields])

    def _files(self, schema: T.StructType) -> _Files:
        return _Files(self.options, schema, self.fields, self.rows, self.splits)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FileReader(self._files(schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return FileStream(self._files(schema))


class PageSource(ElementSource):
    """path, size, page, text and error of every page."""

    fields, rows, splits = PAGE, staticmethod(pages_of), ()

    @classmethod
    def name(cls) -> str:
        return "file_pages"


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let it hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ElementSource)
    spark.dataSource.register(PageSource)


def read_elements(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("file_elements").options(**options).load(path)


def read_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("file_pages").options(**options).load(path)


def packable(found: DataFrame) -> DataFrame:
    """Elements in the form of chunking.element_chunks(): path, at, kind (Heading below the first level), content, page."""
    kind = F.when((F.col("kind") == "Title") & (F.col("level") > 1), "Heading").otherwise(F.col("kind"))
    return found.where("error is null and kind not in ('PageBreak', 'Header', 'Footer')").select("path", "at", kind.alias("kind"), F.col("text").alias("content"), "page")
