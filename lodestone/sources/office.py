"""Text of office documents and PDF files from binary columns, in workers; one row a page, slide or sheet."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _texts(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}" + tag))


def docx(data: bytes) -> list[str]:
    """One page: paragraphs, and table rows with their cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = []
    for part in body:
        if part.tag.endswith("}p"):
            out.append(_texts(part, "t"))
        elif part.tag.endswith("}tbl"):
            for row in (r for r in part.iter() if r.tag.endswith("}tr")):
                out.append(" | ".join(_texts(c, "t").strip() for c in row if c.tag.endswith("}tc")))
    return ["\n".join(x for x in out if x.strip())]


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), m[0]) for m in (re.fullmatch(pattern, n) for n in names) if m]
    return [n for _, n in sorted(found)]


def pptx(data: bytes) -> list[str]:
    """A page for each slide, its paragraphs as lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = [ElementTree.fromstring(z.read(n)) for n in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")]
    return ["\n".join(t for p in s.iter() if p.tag.endswith("}p") and (t := _texts(p, "t")).strip()) for s in slides]


def xlsx(data: bytes) -> list[str]:
    """A page for each sheet, its rows with the cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = [ElementTree.fromstring(z.read(n)) for n in _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml")]

    def cell(c) -> str:
        kind, value = c.get("t"), next((v.text or "" for v in c.iter() if v.tag.endswith("}v")), "")
        if kind == "s":
            return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        return _texts(c, "t") if kind == "inlineStr" else value

    rows = [[" | ".join(cell(c) for c in r if c.tag.endswith("}c")) for r in s.iter() if r.tag.endswith("}row")] for s in sheets]
    return ["\n".join(x for x in page if x.strip(" |")) for page in rows]


def pdf(data: bytes) -> list[str]:
    """The text layer of each page, if a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf}


def pages(files: DataFrame, content: str = "content", name: str = "source_file", readers: dict = READERS) -> DataFrame:
    """source_file, page (from 0), text, error of files; one row with an error for a file that cannot be read."""
    schema = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                file, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                try:
                    reader = readers[(file or "").rpartition(".")[2].lower()]
                    got = [(file, i, t, None) for i, t in enumerate(reader(data or b""))]
                except Exception as e:  # a broken file is a result, not the end of the job
                    got = [(file, None, None, f"{type(e).__name__}: {e}"[:300])]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=schema.names)

    return files.select(name, content).mapInArrow(run, schema)
