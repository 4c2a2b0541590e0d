"""Files and packages to objects.

Bytes are read by Spark (binaryFile); what is in a file is told from its content
where the extension does not say it.  XML and ZIP members need a sequential
parser, so they are read by an Arrow function, file by file, with the limits of
``Budget`` on bytes, members and objects.  A file that cannot be read is a row of
failures and gives no objects; a file that meets a limit keeps those before it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exports import Malformed, xml_objects

#: Extensions of sources.
TEXT_EXTENSIONS = ("txt", "prg", "gxd", "src")
PACKAGE_EXTENSIONS = ("xpz", "zip", "rar")
EXTENSIONS = (*TEXT_EXTENSIONS, "xml", *PACKAGE_EXTENSIONS)
#: The Windows code page where it differs from Latin-1, as the web reads it: five bytes stay control characters.
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
_CONTROL = "".join(map(chr, range(0x80, 0xA0)))


@dataclass(frozen=True)
class Budget:
    """Limits on what one file may cost."""

    input_bytes: int = 256 * 1024 * 1024
    member_bytes: int = 64 * 1024 * 1024
    expanded_bytes: int = 512 * 1024 * 1024
    members: int = 10_000
    objects: int = 100_000


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, with or without a mark, else the Windows code page."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    western = F.translate(F.decode(content, "ISO-8859-1"), _CONTROL, _CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(western)


def decode_bytes(content: bytes) -> str:
    try:
        return content.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return content.decode("latin-1").translate(dict(zip(map(ord, _CONTROL), _CP1252, strict=True)))


def _file_objects(path: str, content: bytes, budget: Budget) -> tuple[list[dict], str | None]:
    """Objects of one file and what went wrong, if anything did."""
    name = path.rsplit("/", 1)[-1]
    stem, _, extension = name.rpartition(".")
    extension = extension.lower()
    if len(content) > budget.input_bytes:
        return [], f"input exceeds {budget.input_bytes} bytes"
    if extension in TEXT_EXTENSIONS:
        text = decode_bytes(content)
        if not text.strip():
            return [], "empty source"
        return [{"id": stem or name, "object_type": "Source", "package": "", "member": name, "text": text, "segments": []}], None
    if content[:4] == b"Rar!":
        return [], "unsupported container: RAR"
    if content[:2] == b"PK":
        return _package_objects(content, budget)
    if extension == "xml" or extension in PACKAGE_EXTENSIONS:
        try:
            found, recognized = xml_objects(decode_bytes(content), stem or name)
        except Malformed as e:
            return [], f"malformed XML: {e}"
        if not found and not recognized:
            return [], "unsupported layout: no objects"
        return [x | {"member": name} for x in found[: budget.objects]], None if len(found) <= budget.objects else f"more than {budget.objects} objects"
    return [], "unsupported extension"


def _package_objects(content: bytes, budget: Budget) -> tuple[list[dict], str | None]:
    out, expanded, recognized = [], 0, 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for k, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
                if k >= budget.members:
                    return out, f"more than {budget.members} members"
                expanded += info.file_size
                if info.file_size > budget.member_bytes or expanded > budget.expanded_bytes:
                    return out, f"member {info.filename} exceeds the limits of size"
                text = decode_bytes(archive.read(info))
                if "<" not in text:
                    continue
                found, n = xml_objects(text, info.filename.rsplit("/", 1)[-1].rpartition(".")[0] or info.filename)
                recognized += n
                out += [x | {"member": info.filename} for x in found]
                if len(out) > budget.objects:
                    return out[: budget.objects], f"more than {budget.objects} objects"
    except Malformed as e:
        return [], f"malformed XML: {e}"
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
        return [], f"unreadable package: {e}"
    return out, None if out or recognized else "unsupported layout: no objects"


OBJECT = "path string, ord int, id string, object_type string, member string, package string, text string, code_start_line int, segments array<struct<kind: string, text_start_line: int, member_start_line: int>>, error string"


_SEGMENT = pa.list_(pa.struct([("kind", pa.string()), ("text_start_line", pa.int32()), ("member_start_line", pa.int32())]))
OBJECT_SCHEMA = pa.schema([(c, {"ord": pa.int32(), "code_start_line": pa.int32(), "segments": _SEGMENT}.get(c, pa.string())) for c in ("path", "ord", "id", "object_type", "member", "package", "text", "code_start_line", "segments", "error")])


def object_row(path: str, place: int, x: dict) -> dict:
    """The row of an object found in a file."""
    return x | {"path": path, "ord": place, "code_start_line": x["segments"][0]["member_start_line"] if x["segments"] else 1, "error": None}


#: Rows and characters of text at which what was found goes on as a batch.
BATCH_ROWS, BATCH_CHARS = 1_000, 1 << 20


def _read(budget: Budget):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, error = _file_objects(path, content, budget)
                rows += [object_row(path, i, x) for i, x in enumerate(found)]
                chars += sum(len(x["text"]) for x in found)
                if error:
                    rows.append(dict.fromkeys(("id", "object_type", "member", "package", "text", "code_start_line", "segments")) | {"path": path, "ord": -1, "error": error})
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, OBJECT_SCHEMA)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, OBJECT_SCHEMA)

    return run


def read_objects(files: DataFrame, budget: Budget | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects, with an object_key, and failures (path, error) of files (path, content)."""
    rows = files.select("path", "content").mapInArrow(_read(budget or Budget()), OBJECT)
    objects = rows.where("error is null").drop("error").withColumn("object_key", F.concat_ws("#", "path", F.col("ord").cast("string")))
    return objects, rows.where("error is not null").select("path", "error")


def package_members(content: bytes) -> list[str]:
    """The members of a package that are no folders."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [i.filename for i in archive.infolist() if not i.is_dir()]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows += [(path, i, name, None) for i, name in enumerate(package_members(content or b""))]
            except (zipfile.BadZipFile, OSError) as e:
                rows.append((path, -1, None, f"unreadable package: {e}"))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "ord", "member", "error"])


def list_members(files: DataFrame) -> DataFrame:
    """path, ord, member, error: a row for each member of each package (path, content), or one with what went wrong."""
    return files.select("path", "content").mapInArrow(_members, "path string, ord int, member string, error string")
