"""Text of word-processing and presentation archives, read part by part under one budget of bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.parsers import expat

from docflow.errors import DocflowError, malformed
from docflow.kernels.text_norm import normalize_whitespace

# Limits and names of the formats.
MAX_DECOMPRESSED = 64 << 20
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
_DOCUMENT = "word/document.xml"
_PRESENTATION, _PRESENTATION_RELS = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
_OFFICE_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NOTES_TYPE = _OFFICE_RELS + "/notesSlide"
_SLIDE = re.compile(r"ppt/slides/slide([+-]?\d+)\.xml")
_BLOCK = 1 << 16


def _local(name: str) -> str:
    return name.rpartition(" ")[2]


class Archive:
    """An archive whose parts are read from one budget."""

    def __init__(self, data: bytes, media_type: str, budget: int = MAX_DECOMPRESSED):
        self.media_type, self.left = media_type, budget
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
            raise self.broken(e) from e
        self.parts = {i.filename: i for i in self.zip.infolist()}

    def broken(self, cause: object) -> DocflowError:
        return malformed(self.media_type, cause)

    def blocks(self, name: str):
        try:
            with self.zip.open(self.parts[name]) as part:
                while block := part.read(min(_BLOCK, self.left + 1)):
                    self.left -= len(block)
                    if self.left < 0:
                        raise self.broken("decompressed content is over the limit")
                    yield block
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as e:
            raise self.broken(e) from e

    def read(self, name: str) -> bytes:
        return b"".join(self.blocks(name))

    def run_text(self, name: str) -> str:
        """Character data of ``t`` elements, a blank line after each ``p``, whatever the namespaces."""
        out: list[str] = []
        inside = [False]
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True

        def start(tag, _):
            if _local(tag) == "t":
                inside[0] = True

        def end(tag):
            if _local(tag) == "t":
                inside[0] = False
            elif _local(tag) == "p":
                out.append("\n\n")

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda data: out.append(data) if inside[0] else None
        empty = True
        try:
            for block in self.blocks(name):
                empty = empty and not block.strip()
                if not empty:
                    parser.Parse(block, False)
            if not empty:
                parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise self.broken(e) from e
        return "".join(out)


def _attributes(data: bytes, root: str, element: str) -> list[dict[str, str]] | None:
    """Attributes of all elements of one local name, or None if the part can't be read or has another root."""
    found: list[dict[str, str]] = []
    roots: list[str] = []
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(tag, attributes):
        if not roots:
            roots.append(_local(tag))
        if _local(tag) == element:
            found.append(attributes)

    parser.StartElementHandler = start
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        return None
    return found if roots == [root] else None


def docx_text(data: bytes, budget: int = MAX_DECOMPRESSED) -> str:
    archive = Archive(data, DOCX, budget)
    if _DOCUMENT not in archive.parts:
        raise archive.broken(f"no {_DOCUMENT}")
    return normalize_whitespace(archive.run_text(_DOCUMENT))


def slide_names(archive: Archive) -> list[str]:
    """Slides as the presentation orders them, then those it doesn't name by number; by number alone where its
    order can't be read."""
    numbered = sorted((int(m[1]), n) for n in archive.parts if (m := _SLIDE.fullmatch(n)))
    named: list[str] = []
    if _PRESENTATION in archive.parts and _PRESENTATION_RELS in archive.parts:
        order = _attributes(archive.read(_PRESENTATION), "presentation", "sldId")
        rels = _attributes(archive.read(_PRESENTATION_RELS), "Relationships", "Relationship")
        targets = {r.get("Id"): r.get("Target", "") for r in rels or []}
        for slide in order or []:
            target = targets.get(slide.get(f"{_OFFICE_RELS} id"))
            if target is not None:
                # Targets are taken relative to ppt/ even if they begin with a slash.
                named.append(posixpath.normpath("ppt/" + target.lstrip("/")) if not target.startswith("/") else posixpath.normpath("ppt" + target))
    named = [n for n in named if n.startswith("ppt/slides/slide") and n.endswith(".xml") and n in archive.parts]
    return list(dict.fromkeys([*named, *(n for _, n in numbered)]))


def pptx_text(data: bytes, budget: int = MAX_DECOMPRESSED) -> str:
    archive = Archive(data, PPTX, budget)
    slides = slide_names(archive)
    if not slides:
        raise archive.broken("no slides")
    out = []
    for name in slides:
        out.append(archive.run_text(name))
        folder, base = posixpath.split(name)
        rels_name = f"{folder}/_rels/{base}.rels"
        if rels_name not in archive.parts:
            continue
        rels = _attributes(archive.read(rels_name), "Relationships", "Relationship")
        if rels is None:
            raise archive.broken(f"{rels_name} can't be read")
        notes = next((r.get("Target", "") for r in rels if r.get("Type") == _NOTES_TYPE), None)
        if notes is not None:
            target = posixpath.normpath(f"{folder}/{notes}")
            if target not in archive.parts:
                raise archive.broken(f"notes {target} of {name} are missing")
            out.append(archive.run_text(target))
    return normalize_whitespace("".join(out))
