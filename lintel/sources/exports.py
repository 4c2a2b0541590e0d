"""Objects of an export's XML.

Tags count in any case.  What is code is known from where a CDATA section lies, so the
parser's events are looked at one by one with the stack of open tags; each document is
a small row of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

#: Tags of sections that hold code, and of parts that hold none.
SECTIONS = ("events", "rules", "subroutines")
NO_CODE = ("documentation", "layout", "help", "structure")


class Malformed(ValueError):
    """A file that is no such document."""


@dataclass
class Section:
    """A code section: its tag as written, its open depth, its text and the line that this begins at."""

    kind: str
    depth: int
    text: list[str] = field(default_factory=list)
    line: int = 1


@dataclass
class Found:
    """An object as far as it has been read."""

    type: str = ""
    name: str = ""
    package: str = ""
    sections: list[Section] = field(default_factory=list)

    def row(self, stem: str) -> dict:
        """Its sections as one text with an empty line between, and where in the member each begins."""
        texts, segments, line = [], [], 1
        for s in self.sections:
            segments.append({"kind": s.kind, "text_start_line": line, "member_start_line": s.line})
            texts.append("".join(s.text))
            line += texts[-1].count("\n") + 2
        return {"id": self.name or stem, "object_type": self.type or "Source", "package": self.package, "text": "\n\n".join(texts), "segments": segments}


class Export:
    """Handlers of one document's events."""

    def __init__(self, parser):
        self.parser = parser
        self.open: list[str] = []
        self.objects: list[Found] = []
        self.recognized = 0
        self.current: Found | None = None
        self.loose = Found()
        self.section: Section | None = None
        self.cdata = False
        #: what of an object's identity is being read, and its text so far
        self.reading: tuple[str, list[str]] | None = None
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.characters
        parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = self.begin, self.finish

    def start(self, tag: str, attributes: dict) -> None:
        low, above = tag.lower(), self.open[-1] if self.open else None
        if above is None:
            known = {k.lower(): v.strip() for k, v in attributes.items()}
            self.loose = Found(tag, known.get("name", ""), known.get("package", ""))
        self.open.append(low)
        if low == "gxobject":
            self.recognized += 1
            self.current, self.section = Found(), None
            return
        if above == "gxobject" and self.current and not self.current.type and low not in NO_CODE:
            self.current.type = tag
        if any(x in NO_CODE for x in self.open):
            return
        if self.current and "info" in self.open[:-1] and low in ("name", "folder") and not self.reading:
            self.reading = (low, [])
        if low in SECTIONS and not self.section:
            self.section = Section(tag, len(self.open))

    def end(self, tag: str) -> None:
        low, depth = tag.lower(), len(self.open)
        self.open.pop()
        if self.section and self.section.depth == depth:
            if "".join(self.section.text).strip():
                (self.current or self.loose).sections.append(self.section)
            self.section = None
        if self.reading and self.reading[0] == low:
            value = "".join(self.reading[1]).strip()
            if self.current and low == "name":
                self.current.name = value
            elif self.current:
                self.current.package = value
            self.reading = None
        if low == "gxobject" and self.current:
            if self.current.sections:
                self.objects.append(self.current)
            self.current = None

    def characters(self, text: str) -> None:
        if self.cdata and self.section:
            self.section.text.append(text)
        elif not self.cdata and self.reading:
            self.reading[1].append(text)

    def begin(self) -> None:
        self.cdata = True
        if self.section and not self.section.text:
            self.section.line = self.parser.CurrentLineNumber

    def finish(self) -> None:
        self.cdata = False


def xml_objects(text: str, stem: str = "") -> tuple[list[dict], int]:
    """Objects with code of an export, and how many objects it has in all; stem names objects without a name.

    A document without objects is one object of all its sections, named by its root.
    """
    parser = expat.ParserCreate("utf-8")
    export = Export(parser)
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", lambda m: "\n" * m[0].count("\n"), text, count=1).encode(), True)
    except expat.ExpatError as e:
        raise Malformed(str(e)) from e
    found = export.objects
    if not export.recognized and export.loose.sections:
        found = [export.loose]
    return [x.row(stem) for x in found], export.recognized
