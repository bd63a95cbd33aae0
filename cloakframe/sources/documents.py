"""Document formats: readable text of HTML, mail boxes, DOCX files; and the mail record's writer.

These run as Arrow maps over ``binaryFile`` rows or text columns; each file is handled by one task."""

from __future__ import annotations

import email
import email.policy
import html as entities
import io
import re
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIL_FIELDS = ("date", "folder", "from", "toRecipients", "ccRecipients", "bccRecipients", "subject", "hasAttachments", "attachmentNames", "completeHeader", "body")
BREAKS = frozenset("p div br tr li ul ol table h1 h2 h3 h4 h5 h6 blockquote pre hr section article header footer".split())
HIDDEN = frozenset("script style head title".split())
MAX_ZIP_BYTES = 256 << 20
WORD_PARTS = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml")
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.out.append("\n" if tag in BREAKS else "\t" if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.out.append("\n" if tag in BREAKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def readable(source: str | None) -> str | None:
    """The text a reader sees: no scripts, blocks on lines, cells after tabs, no invisible characters."""
    if source is None:
        return None
    reader = _Reader()
    try:
        reader.feed(source)
        reader.close()
        text = "".join(reader.out)
    except Exception:  # markup that the parser refuses: tags are cut out by pattern
        text = entities.unescape(re.sub(r"<[^>]+>", " ", source))
    text = re.sub("[\u200b-\u200f\u2060\ufeff]", "", text).replace("\xa0", " ")
    lines = [re.sub(r"[ \r\f\v]+", " ", line).strip(" \t") for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def readable_text(df: DataFrame, column: str, out: str = "text") -> DataFrame:
    """``df`` with the readable text of an HTML column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in b.schema.names if n != out} | {out: pa.array([readable(x) for x in b.column(column).to_pylist()], pa.string())})

    base = df.drop(out)
    return base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{out}` string")


def mail_record(raw: bytes, folder: str = "") -> dict[str, str]:
    """One message as the eleven text fields; display names are dropped, addresses kept."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    people = lambda h: "; ".join(a for _, a in getaddresses(m.get_all(h, [])) if a)
    parts = {"text/plain": None, "text/html": None}
    names = []
    for p in m.walk():
        if p.get_filename():
            names.append(p.get_filename())
        elif p.get_content_type() in parts and parts[p.get_content_type()] is None:
            parts[p.get_content_type()] = (p.get_payload(decode=True) or b"").decode(p.get_content_charset() or "utf-8", "replace")
    body = parts["text/plain"] if parts["text/plain"] is not None else readable(parts["text/html"] or "")
    values = (m.get("Date", ""), folder, people("From"), people("To"), people("Cc"), people("Bcc"), m.get("Subject", ""), str(bool(names)).lower(), "; ".join(names), "\n".join(f"{k}: {v}" for k, v in m.items()), body)
    return dict(zip(MAIL_FIELDS, map(str, values), strict=True))


def read_mbox(files: DataFrame) -> DataFrame:
    """Records of mbox files (``binaryFile`` rows), one row for each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                parts = re.split(rb"(?m)^From [^\n]*\n", content)
                rows = [mail_record(p, path.rpartition("/")[2].removesuffix(".mbox")) for p in parts if p.strip()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f, pa.string()) for f in MAIL_FIELDS]))

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{f}` string" for f in MAIL_FIELDS))


def _open_parts(data: bytes) -> dict[str, bytes]:
    """Members of a DOCX, within the size budget (declared and real sizes)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_ZIP_BYTES:
            raise ValueError("the file unpacks to more than the budget")
        out, left = {}, MAX_ZIP_BYTES
        for i in z.infolist():
            with z.open(i) as f:
                out[i.filename] = f.read(left + 1)
            left -= len(out[i.filename])
            if left < 0:
                raise ValueError("the file unpacks to more than the budget")
        return out


def docx_paragraphs(data: bytes) -> list[tuple[str, int, str]]:
    """(part, paragraph number, text) of a DOCX."""
    out = []
    for name, xml in sorted(_open_parts(data).items()):
        if WORD_PARTS.fullmatch(name):
            for i, p in enumerate(ElementTree.fromstring(xml).iter(f"{W_NS}p")):
                marks = {f"{W_NS}tab": "\t", f"{W_NS}br": "\n", f"{W_NS}cr": "\n"}
                text = "".join(n.text or "" if n.tag == f"{W_NS}t" else marks.get(n.tag, "") for n in p.iter())
                if text:
                    out.append((name, i, text))
    return out


def rewrite_docx(data: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """The DOCX with the given paragraphs' texts (in their first run) and without author and company."""
    parts, out = _open_parts(data), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            if WORD_PARTS.fullmatch(name):
                root = ElementTree.fromstring(body)
                for i, p in enumerate(root.iter(f"{W_NS}p")):
                    runs = list(p.iter(f"{W_NS}t"))
                    if (name, i) in texts and runs:
                        for t in runs:
                            t.text = ""
                        runs[0].text = texts[name, i]
                        runs[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                body = ElementTree.tostring(root)
            elif name in ("docProps/core.xml", "docProps/app.xml"):
                root = ElementTree.fromstring(body)
                for e in root.iter():
                    if e.tag.rpartition("}")[2] in ("creator", "lastModifiedBy", "Company", "Manager"):
                        e.text = "[ELIDED]"
                body = ElementTree.tostring(root)
            z.writestr(name, body)
    return out.getvalue()


def read_docx(files: DataFrame) -> DataFrame:
    """(path, part, at, text): the paragraphs of DOCX files, ready for text masking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *x) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for x in docx_paragraphs(c)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "part", "at", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, part string, at long, text string")


def write_docx(files: DataFrame, masked: DataFrame) -> DataFrame:
    """(path, content): the files with their masked paragraphs (path, part, at, text)."""
    lists = masked.groupBy("path").agg(F.collect_list(F.struct("part", "at", "text")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rewrite_docx(c, {(t["part"], t["at"]): t["text"] for t in ts or []}) for c, ts in zip(b.column("content").to_pylist(), b.column("texts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return files.select("path", "content").join(lists, "path", "left").mapInArrow(run, "path string, content binary")
