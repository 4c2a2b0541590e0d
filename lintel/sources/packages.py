"""Packages as a data source that is read member by member.

``spark.read.format("lintel_package").load(path)`` plans from the packages' central
directories: a package of over ``splitBytes`` is cut into ranges of members of about
that size, and each range is a partition of its own, so a large package is many tasks'
work; ranges share partitions where there would be more than ``PARTITIONS``.  Smaller
packages are not opened while planning and share partitions.  Filters on
path and member reach the plan (spark.sql.python.filterPushdown.enabled): packages that
no filter admits are not opened, members that none admits are not inflated.

Options: path (a file, a folder, or a glob; several with commas), splitBytes,
maxMembers, maxMemberBytes, maxExpandedBytes (``Budget``'s by default).  Paths are opened
through pyarrow's file systems; for stores that only Spark reads there is
``readers.read_objects`` over binaryFile.

Rows: path, ord (the member's place), member, bytes, content, error.  A member beyond a
limit is a row with an error and no content; a package that can't be read is one row
with ord -1.
"""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .exports import Malformed, xml_objects
from .readers import OBJECT, OBJECT_SCHEMA, Budget, decode_bytes, object_row

FORMAT = "lintel_package"
SCHEMA = "path string, ord int, member string, bytes long, content binary, error string"
SPLIT_BYTES = 16 * 1024 * 1024
#: Most partitions of a plan, beyond which ranges share one, and the rows and bytes at which members go on as a batch.
PARTITIONS, BATCH_ROWS, BATCH_BYTES = 2_000, 1_000, 1 << 20
#: What a file that is no package raises; pyarrow's files raise a ValueError where a place before their beginning is asked for.
UNREADABLE = (zipfile.BadZipFile, OSError, ValueError)
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, v: v in x}


@dataclass
class Members(InputPartition):
    """Members [first, last) of packages; last None: all."""

    parts: list[tuple[str, int, int | None]]


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)


def opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def written(path: str, content: bytes) -> None:
    """Write a file at once: under another name first, so that a lost task leaves no half of one."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def listed(paths: str) -> Iterator[tuple[str, int]]:
    """path, bytes of the packages that the paths mean."""
    for path in filter(None, map(str.strip, paths.split(","))):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        folder, _, last = inner.rpartition("/")
        if any(c in last for c in "*?["):
            found = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(i.base_name, last)]
        else:
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        for i in sorted(found, key=lambda i: i.path):
            if i.type == fs.FileType.File:
                yield head + i.path, i.size


def members_of(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in archive.infolist() if not i.is_dir()]


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        budget = Budget()
        number = lambda key, default: int(options.get(key, default))
        self.path, self.split = options["path"], number("splitBytes", SPLIT_BYTES)
        self.limits = number("maxMembers", budget.members), number("maxMemberBytes", budget.member_bytes), number("maxExpandedBytes", budget.expanded_bytes)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("member",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _admits(self, column: str, value: str) -> bool:
        return all(_TESTS[kind](value, wanted) for c, kind, wanted in self.tests if c == column)

    def partitions(self) -> list[Members]:
        out, small, size = [], [], 0
        for path, n in listed(self.path):
            if not self._admits("path", path):
                continue
            if n > self.split:
                out += [Members([(path, a, b)]) for a, b in self._ranges(path)]
                continue
            if small and size + n > self.split:
                out.append(Members(small))
                small, size = [], 0
            small.append((path, 0, None))
            size += n
        return _shared([*out, Members(small)] if small or not out else out)

    def _ranges(self, path: str) -> Iterator[tuple[int, int | None]]:
        try:
            with opened(path) as f, zipfile.ZipFile(f) as archive:
                sizes = [i.compress_size for i in members_of(archive)]
        except UNREADABLE:
            yield 0, None
            return
        first, size = 0, 0
        for k, n in enumerate(sizes):
            if k > first and size + n > self.split:
                yield first, k
                first, size = k, 0
            size += n
        yield first, len(sizes)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[4] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, partition: Members) -> Iterator[tuple]:
        for path, first, last in partition.parts:
            try:
                with opened(path) as f, zipfile.ZipFile(f) as archive:
                    infos = members_of(archive)
                    upto = list(accumulate(i.file_size for i in infos))
                    for k in range(first, len(infos) if last is None else last):
                        if self._admits("member", infos[k].filename):
                            yield (path, k, infos[k].filename, infos[k].file_size, *self._member(archive, infos[k], k, upto[k]))
            except UNREADABLE as e:
                if first == 0:
                    yield path, -1, None, None, None, f"unreadable package: {e}"

    def _member(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo, k: int, upto: int) -> tuple[bytes | None, str | None]:
        members, member_bytes, expanded = self.limits
        if k >= members:
            return None, f"more than {members} members"
        if info.file_size > member_bytes:
            return None, f"member {info.filename} exceeds {member_bytes} bytes"
        if upto > expanded:
            return None, f"member {info.filename} exceeds {expanded} bytes of the package"
        try:
            return archive.read(info), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
            return None, f"unreadable member: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def _shared(partitions: list[Members]) -> list[Members]:
    """At most ``PARTITIONS`` of them; ranges of one package that meet become one."""
    each = -(-len(partitions) // PARTITIONS)
    if each <= 1:
        return partitions
    out = []
    for at in range(0, len(partitions), each):
        parts: list[tuple[str, int, int | None]] = []
        for path, first, last in (x for m in partitions[at : at + each] for x in m.parts):
            if parts and parts[-1][0] == path and parts[-1][2] == first:
                first = parts.pop()[1]
            parts.append((path, first, last))
        out.append(Members(parts))
    return out


def read_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, ord, member, bytes, content, error of the members of packages."""
    spark.dataSource.register(PackageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, k, member, content in zip(*(batch.column(c).to_pylist() for c in ("path", "ord", "member", "content")), strict=True):
            text = decode_bytes(content)
            if "<" not in text:
                continue
            try:
                found, _ = xml_objects(text, member.rsplit("/", 1)[-1].rpartition(".")[0] or member)
                rows += [object_row(path, i, x | {"member": member}) | {"place": k} for i, x in enumerate(found)]
            except Malformed as e:
                rows.append(dict.fromkeys(OBJECT_SCHEMA.names) | {"path": path, "ord": -1, "place": k, "error": f"malformed XML: {e}"})
        yield pa.RecordBatch.from_pylist(rows, OBJECT_SCHEMA.append(pa.field("place", pa.int32())))


def read_package_objects(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Objects of packages, each member read where its partition lies, and failures (path, error).

    As of files, objects have an object_key; ord counts within the member, place is the member's.
    """
    members = read_members(spark, path, **options)
    rows = members.where("error is null").select("path", "ord", "member", "content").mapInArrow(_objects, OBJECT + ", place int")
    objects = rows.where("error is null").drop("error").withColumn("object_key", F.concat_ws("#", "path", F.col("place").cast("string"), F.col("ord").cast("string")))
    return objects, members.where("error is not null").select("path", "error").union(rows.where("error is not null").select("path", "error"))
