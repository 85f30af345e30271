"""Cleaning of DOCX files: revisions, hidden and struck text, comments, fields, macros. Standard library only.

A file is opened once; each rule changes the parsed parts, and one write ends it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import pieces, unfold

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# ---- Fixed values: names in the file format. ----
MAIN = "word/document.xml"
TEXT_PREFIXES = ("header", "footer", "footnotes", "endnotes")
UNWRAP = ("ins", "moveTo", "cellIns", "cellMerge")
REMOVE = ("del", "moveFrom", "cellDel")
CHANGES = ("pPrChange", "rPrChange", "tblPrChange", "tcPrChange", "trPrChange", "sectPrChange", "numberingChange")
COMMENT_TAGS = ("commentRangeStart", "commentRangeEnd", "commentReference")
COMMENT_PARTS = ("word/comments.xml", "word/commentsExtended.xml", "word/commentsIds.xml", "word/commentsExtensible.xml", "word/people.xml")
MACRO_PARTS = ("word/vbaProject.bin", "word/vbaData.xml", "word/vbaProjectSignature.bin")
# ---- End of fixed values. ----


class Package:
    """The parts of a file, parsed where asked for."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist()}
        self.trees: dict[str, ET.Element] = {}

    def text_parts(self) -> list[str]:
        return [n for n in self.parts if n == MAIN or n.startswith("word/") and n.endswith(".xml") and n[5:].startswith(TEXT_PREFIXES)]

    def tree(self, part: str) -> ET.Element | None:
        if part not in self.trees and part in self.parts:
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(self.parts[part]), events=["start-ns"]):
                if not prefix.startswith("ns"):
                    ET.register_namespace(prefix, uri)
            self.trees[part] = ET.fromstring(self.parts[part])
        return self.trees.get(part)

    def drop(self, names) -> int:
        gone = [n for n in names if n in self.parts]
        for n in gone:
            del self.parts[n]
            self.trees.pop(n, None)
        return len(gone)

    def forget(self, names) -> None:
        """Remove what other parts say of dropped parts: content types and relations."""
        wanted = {n.rpartition("/")[2] for n in names}
        for part, attribute in (("[Content_Types].xml", "PartName"), ("word/_rels/document.xml.rels", "Target")):
            root = self.tree(part)
            for child in list(root) if root is not None else ():
                if child.get(attribute, "").rpartition("/")[2] in wanted:
                    root.remove(child)

    def write(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in self.parts.items():
                if name in self.trees:
                    content = ET.tostring(self.trees[name], encoding="UTF-8", xml_declaration=True)
                z.writestr(name, content)
        return out.getvalue()


def _rebuild(parent: ET.Element, instead: Callable[[ET.Element], tuple | None]) -> int:
    """Replace the children for which ``instead`` returns others, in one pass; the text after them stays."""
    kept: list[ET.Element] = []
    n = 0
    for child in parent:
        new = instead(child)
        if new is None:
            kept.append(child)
            continue
        n += 1
        kept += new
        if child.tail and kept:
            kept[-1].tail = (kept[-1].tail or "") + child.tail
        elif child.tail:
            parent.text = (parent.text or "") + child.tail
    if n:
        parent[:] = kept
    return n


def _each(root: ET.Element, tags: tuple, instead: Callable[[ET.Element], tuple]) -> int:
    """Replace every element with one of the tags, inner ones first."""
    names = {W + t for t in tags}
    return sum(_rebuild(x, lambda c: instead(c) if c.tag in names else None) for x in reversed(list(root.iter())))


def accept_revisions(p: Package) -> int:
    """Keep insertions, remove deletions and records of changed properties."""
    n = 0
    for part in p.text_parts():
        root = p.tree(part)
        n += _each(root, UNWRAP, tuple) + _each(root, REMOVE, lambda x: ()) + _each(root, CHANGES, lambda x: ())
    return n


def _runs_with(p: Package, *marks: str) -> int:
    n = 0
    marked = lambda x: x.tag == W + "r" and (rpr := x.find(W + "rPr")) is not None and any(rpr.find(W + m) is not None for m in marks)
    for part in p.text_parts():
        n += sum(_rebuild(x, lambda c: () if marked(c) else None) for x in list(p.tree(part).iter()))
    return n


def remove_hidden(p: Package) -> int:
    return _runs_with(p, "vanish")


def remove_struck(p: Package) -> int:
    return _runs_with(p, "strike", "dstrike")


def strip_comments(p: Package) -> int:
    root = p.tree(MAIN)
    n = _each(root, COMMENT_TAGS, lambda x: ()) if root is not None else 0
    if p.drop(COMMENT_PARTS):
        p.forget(COMMENT_PARTS)
    return n


class _Field:
    """A field that is open: the runs before its separator, which go if it is closed after one."""

    def __init__(self):
        self.before: list[ET.Element] = []
        self.result = False


def _field_runs(root: ET.Element) -> tuple[set[ET.Element], int]:
    """The runs that are not part of a complex field's result, and how many fields that are results or stand in none have one."""
    gone: set[ET.Element] = set()
    fields = 0
    open_fields: list[_Field] = []
    for run in root.iter(W + "r"):
        mark = run.find(W + "fldChar")
        kind = mark.get(W + "fldCharType") if mark is not None else None
        closed = None
        if kind == "begin":
            open_fields.append(_Field())
        elif kind == "separate" and open_fields:
            open_fields[-1].result = True
        elif kind == "end" and open_fields:
            closed = open_fields.pop()
        for field in open_fields:
            if not field.result:
                field.before.append(run)
        if closed is not None and closed.result:
            gone.update(closed.before, [run])
            fields += all(field.result for field in open_fields)
    return gone, fields


def freeze_fields(p: Package) -> int:
    """Fields become their results: simple ones are unwrapped; of complex ones what is before the separator and the end go.

    Each separator and end belong to the field that was opened last, so a field
    in another's result is frozen by itself and the outer result stays whole.
    """
    n = 0
    for part in p.text_parts():
        root = p.tree(part)
        n += _each(root, ("fldSimple",), tuple)
        gone, fields = _field_runs(root)
        if gone:
            for x in list(root.iter()):
                _rebuild(x, lambda c: () if c in gone else None)
        n += fields
    return n


def strip_macros(p: Package) -> int:
    n = p.drop(MACRO_PARTS)
    if n:
        p.forget(MACRO_PARTS)
    return n


RULES: list[tuple[str, Callable[[Package], int]]] = [
    ("accept_revisions", accept_revisions), ("remove_vanish", remove_hidden), ("remove_strikethrough", remove_struck),
    ("strip_comments", strip_comments), ("freeze_fields", freeze_fields), ("strip_macros", strip_macros),
]


def clean_bytes(content: bytes, rules=RULES) -> tuple[bytes, dict[str, int]]:
    """The cleaned file and each rule's changes; a rule that fails counts none and leaves the file as it was.

    The file is opened and written once. Only after a failure is it opened
    again, and the rules that succeeded are repeated.
    """
    p, counts, done = Package(content), {}, []
    for name, rule in rules:
        try:
            counts[name] = rule(p)
            done.append(rule)
        except Exception:  # one rule's failure must not lose the others' work
            counts[name] = 0
            p = Package(content)
            for again in done:
                again(p)
    return (p.write() if any(counts.values()) else content), counts


def clean(files: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, content) files as cleaned content, changes by rule, and an error for files that can't be opened."""

    def run(batches):
        for batch in pieces(batches):
            out = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out.append((doc_id, *clean_bytes(content, rules), None))
                except (zipfile.BadZipFile, TypeError) as e:
                    out.append((doc_id, content, {}, str(e)))
            ids, contents, counts, errors = zip(*out, strict=True) if out else ((),) * 4
            kind = pa.map_(pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(contents, pa.binary()), pa.array([list(c.items()) for c in counts], kind), pa.array(errors, pa.string())], names=["doc_id", "content", "changes", "error"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, content binary, changes map<string,bigint>, error string")


def changes_by_rule(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode("changes").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n_changes"))


def document_parts(files: DataFrame) -> DataFrame:
    """(doc_id, part, xml) of the text-bearing parts of DOCX files (doc_id, content)."""

    def read(content: bytes):
        p = Package(bytes(content))
        return [(name, p.parts[name].decode()) for name in p.text_parts()]

    return unfold(files, "content", read, "part string, xml string")


def body_items(content: bytes) -> list[tuple]:
    """(pos, kind, text, level, parent, cells) of a file's paragraphs and tables; headings by style, parents by a stack as deep as the level."""
    root = Package(content).tree(MAIN)
    rows, stack = [], []
    said = lambda x: "".join(t.text or "" for t in x.iter(W + "t")).strip()
    inside = {p for t in root.iter(W + "tbl") for p in t.iter(W + "p")}
    for x in root.iter():
        if x.tag == W + "tbl":
            cells = [[said(c) for c in r.findall(W + "tc")] for r in x.findall(W + "tr")]
            rows.append((len(rows), "table", "", None, stack[-1] if stack else None, cells))
        elif x.tag == W + "p" and x not in inside and said(x):
            style = x.find(f"{W}pPr/{W}pStyle")
            style = style.get(W + "val", "") if style is not None else ""
            level = int(style.removeprefix("Heading")) if style.removeprefix("Heading") in ("1", "2", "3", "4", "5", "6") else None
            if level:
                del stack[level - 1 :]
            rows.append((len(rows), "heading" if level else "paragraph", said(x), level, stack[-1] if stack else None, None))
            if level:
                stack.append(rows[-1][0])
    return rows


def extracted_annotations(files: DataFrame) -> DataFrame:
    """Ground truth from DOCX files (doc_id, content): every paragraph, heading and table in order."""

    return unfold(files, "content", lambda content: body_items(bytes(content)), "pos int, type string, text string, global_level int, parent int, cell_matrix array<array<string>>")
