"""Splitting structured legal texts into chunks: articles, then clauses or paragraphs, packed to a size.

A document is cleaned once and cut at article headings; the pieces of an article are packed in order. Pages follow from the markers in
the text: the page that is current where a chunk begins and the last one it comes to. Everything a document needs is in its own row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# How headings, clauses, paragraphs, page marks and end tables are written.
HEADING = re.compile(
    r"(?<!\w)(?:(?P<kind>ek|ge[çc][iİ]c[iİ]|muvakkat)\s+madde(?:\s*(?P<n>\d+))?|madde\s+(?P<range>\d+\s+il[âa]\s+\d+)|madde\s+(?P<no>\d+(?:[ \t]+\d+)?))\s*[-–—.:]?",
    re.IGNORECASE,
)
CLAUSE = re.compile(r"(?m)(?:^|\s)(?:[a-zA-ZçğıöşüÇĞİÖŞÜ]\)\s+|\d+\s*[-–]\s+)")
PARAGRAPH = re.compile(r"(?m)^\s*\(\d+\)\s+")
PAGE = re.compile(r"\[\[RAG_PAGE:(\d+)\]\]")
END_TABLE = re.compile(
    r"(?i)DEĞİŞİKLİKLER CETVELİ|YÜRÜRLÜKTEN KALDIRDIĞI KANUN|YÜRÜRLÜĞE GİRİŞ TARİHİNİ GÖSTER|ÇEŞİTLİ MEVZUAT İLE YAPILAN|EK VE DEĞİŞİKLİK YAPAN MEVZUATIN|EK VE DEĞİŞİKLİK GETİREN|"
    r"GÖSTERİR LİSTE|Kanun Yürürlüğe\s+No\.|Farklı tarihte Yürürlüğe giren"
)
TITLE = re.compile(r"(?:\A|\n\s*\n)\s*([A-ZÇĞİÖŞÜ][^\n]{2,100})\s*\Z")
LAW_HEADER = re.compile(r"\bKanun\s*(?:Numarası|Numarasi|No\.?|N[oº])\s*[:\-]?\s*(\d{2,8})\b", re.IGNORECASE)
LAW_TITLE = re.compile(r"\b(\d{2,8})\s+sayılı\s+kanun\b", re.IGNORECASE)


@dataclass(frozen=True)
class Options:
    size: int = 800
    overlap: int = 150
    small: int = 250
    least: int = 30
    compat_join: bool = False  # sentences of an overlong section put together without a blank
    plain: bool = False  # the simpler scheme: no overlap, no end tables, no joining of small ends


@dataclass
class Article:
    number: str | None
    kind: str
    text: str
    start: int
    page: int | None = None
    chunks: list = field(default_factory=list)


def clean(text: str) -> str:
    """The text as functions.text.clean_text() has it."""
    text = re.sub(r"\n?\s*[—\-]{5,}\s*\n?", "\n", text or "")
    text = re.sub(r"(?m)^\s*\d{1,4}(?:-\d{1,2})?\s*$", "", text)
    text = re.sub(r"\s*\((\d+)\)\s*\n", r" (\1) ", text).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def label(m: re.Match) -> tuple[str, str]:
    """(number, kind) of a heading."""
    if m["no"]:
        return re.sub(r"\s", "", m["no"]), "madde"
    if m["range"]:
        return re.sub(r"\s+", " ", m["range"]), "madde"
    first = m["kind"][0].lower()
    name, kind = {"e": ("Ek Madde", "ek_madde"), "g": ("Geçici Madde", "gecici_madde"), "m": ("Muvakkat Madde", "muvakkat_madde")}[first]
    return (f"{name} {m['n']}" if m["n"] else name), kind


def articles(text: str, options: Options = Options()) -> list[Article]:
    """The articles of a cleaned text, with what precedes the first; a short title right before a heading goes with it."""
    if not options.plain and (m := END_TABLE.search(text)):
        text = text[: m.start()].strip()
    if not text:
        return []
    cuts: list[tuple[int, str | None, str]] = []
    last = 0
    for m in HEADING.finditer(text):
        start = m.start()
        t = TITLE.search(text[last:start])
        if t and not re.search(r"[.;:!?()\d]", t[1].strip()):
            start = last + t.start(1)
        cuts.append((start, *label(m)))
        last = m.end()
    if not cuts:
        cuts = [(0, None, "legal_document")]
    elif cuts[0][0] > 0:
        cuts.insert(0, (0, None, "preamble"))
    marks = [(m.end(), int(m[1])) for m in PAGE.finditer(text)]
    ends = [end for end, _ in marks]
    out = []
    for (start, number, kind), end in zip(cuts, [c[0] for c in cuts[1:]] + [len(text)], strict=True):
        if body := text[start:end].strip():
            before = bisect_right(ends, start)
            out.append(Article(number, kind, body, start, marks[before - 1][1] if before else None))
    return out


def sections(text: str) -> list[str]:
    """A long article's clauses, if it has two or more, else its paragraphs, else its blocks between empty lines."""
    for pattern in (CLAUSE, PARAGRAPH):
        at = [m.start() for m in pattern.finditer(text)]
        if len(at) > 1:
            return [s for a, b in zip([0, *at], [*at, len(text)], strict=True) if (s := text[a:b].strip())]
    return [s for p in re.split(r"\n\s*\n", text) if (s := p.strip())]


def hard_split(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters, cut at the last blank of their second half if there is one; no text is lost."""
    out, text = [], text.strip()
    while len(text) > size:
        cut = text.rfind(" ", 0, size + 1)
        cut = cut if cut >= size // 2 else size
        out.append(text[:cut].strip())
        text = text[cut:].lstrip()
    return [*out, text] if text else out


def _sentences(section: str, options: Options) -> list[str]:
    glue = "" if options.compat_join else " "
    out: list[str] = [""]
    for s in re.split(r"(?<=[.!?])\s+", section):
        if len(s) > options.size:
            out += [*hard_split(s, options.size), ""]
        elif out[-1] and len(out[-1]) + len(s) + 1 <= options.size:
            out[-1] += glue + s
        elif out[-1]:
            out.append(s)
        else:
            out[-1] = s
    return [s for s in out if s.strip()]


def pack(text: str, options: Options = Options()) -> list[tuple[str, int]]:
    """(chunk, characters taken over from the chunk before) of one article."""
    if len(text) <= options.size:
        return [(text, 0)]
    raw: list[tuple[str, int]] = []
    open_, over = "", 0
    for s in sections(text):
        if len(s) > options.size:
            raw += [(open_, over)] if open_ else []
            raw += [(x, 0) for x in _sentences(s, options)]
            open_, over = "", 0
        elif not open_:
            open_, over = s, 0
        elif len(open_) + 2 + len(s) <= options.size:
            open_ += "\n\n" + s
        else:
            raw.append((open_, over))
            tail = open_[-options.overlap :] if not options.plain and 0 < options.overlap < len(open_) else ""
            tail = tail[tail.find(" ") + 1 :]
            open_, over = (f"{tail}\n\n{s}", len(tail)) if tail else (s, 0)
    raw += [(open_, over)] if open_ else []
    out: list[tuple[str, int]] = []
    for chunk, over in raw:
        for n, part in enumerate(hard_split(chunk, options.size)):
            if out and not options.plain and len(part) < options.small and len(out[-1][0]) + len(part) + 2 <= options.size:
                out[-1] = (out[-1][0] + "\n\n" + part, out[-1][1])
            else:
                out.append((part, over if n == 0 else 0))
    return out


def law_number(source_file: str, given: str | None, text: str = "") -> str:
    """From the file's name, else as given, else from the document's head."""
    if m := re.match(r"\s*(\d{2,8})(?=[_\s.-]|$)", source_file or ""):
        return m[1]
    given = (given or "").strip()
    if given and given.lower() != "unknown":
        return given
    head = (text or "")[:4000]
    m = LAW_HEADER.search(head) or LAW_TITLE.search(head)
    return m[1] if m else "unknown"


def chunk_id(law: str, source: str, document: str, article: str | None, index: int, text: str) -> str:
    part = "preamble" if article is None else re.sub(r"\s+", "_", article)
    who = f"{source}|{document}" if document else source
    return f"{law}_{part}_{index:05d}_{hashlib.sha256(f'{who}|{part}|{' '.join(text.split())}'.encode()).hexdigest()[:12]}"


def chunks(text: str, source_file: str = "unknown", law: str | None = None, document: str = "", page: int | None = None, options: Options = Options()) -> list[dict]:
    """The chunks of one document, in order, those of `least` characters or fewer left out."""
    out = []
    number = law_number(source_file, law, text)
    for a in articles(clean(text), options):
        now = a.page if a.page is not None else page
        for i, (raw, over) in enumerate(pack(a.text, options)):
            marks = [(m.start(), int(m[1])) for m in PAGE.finditer(raw)]
            first = marks[0][1] if marks and not raw[: marks[0][0]].strip() else now
            fresh = [p for at, p in marks if at >= over] or [first]
            body = PAGE.sub("", raw).strip()
            if len(body) > options.least:
                out.append({"chunk_id": chunk_id(number, source_file, document, a.number, i, body), "law_number": number, "article_no": a.number, "article_type": a.kind, "chunk_index": i, "text": body, "chunk_length": len(body), "page_start": first, "page_end": fresh[-1]})
            now = fresh[-1] if marks else now
    return out


SCHEMA = "chunk_id string, law_number string, article_no string, article_type string, chunk_index int, text string, chunk_length int, page_start int, page_end int"


def split(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """docs (source_file, text, and any of law_number, document_id, page_start) as chunks; other columns pass through, ordinal counts the chunks of a document."""
    made = T._parse_datatype_string(SCHEMA).fields
    names = [f.name for f in made]
    kept = [c for c in docs.columns if c not in names and c != "ordinal"]
    schema = T.StructType([docs.schema[c] for c in kept] + made + [T.StructField("ordinal", T.IntegerType())])
    extra = [c for c in ("law_number", "page_start") if c in docs.columns]

    def run(batches):
        kinds = [pa.string()] * 4 + [pa.int32(), pa.string()] + [pa.int32()] * 3
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in (*kept, "__text", *(f"__{e}" for e in extra))}
            value = lambda n, k: b.column(at[n])[k].as_py() if n in at else None  # noqa: B023, E731
            rows, source = [], []
            for k in range(b.num_rows):
                got = chunks(value("__text", k) or "", value("source_file", k) or "unknown", value("__law_number", k), str(value("document_id", k) or ""), value("__page_start", k), options)
                for n, c in enumerate(got):
                    rows.append((*c.values(), n))
                    source.append(k)
            take = pa.array(source, pa.int64())
            cols = [b.column(at[c]).take(take) for c in kept]
            cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate([*kinds, pa.int32()])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    from pyspark.sql import functions as F

    return docs.select(*kept, F.col("text").alias("__text"), *(F.col(e).alias(f"__{e}") for e in extra)).mapInArrow(run, schema)


def enriched(rows: DataFrame) -> DataFrame:
    """Chunks with defaults for what is missing; an article number that is missing is read from the text, an id is made from file, place and text."""
    from pyspark.sql import functions as F

    have = set(rows.columns)
    col = lambda n, default="unknown": F.coalesce(F.col(n).cast("string"), F.lit(default)) if n in have else F.lit(default)
    article = F.coalesce(*([F.col("article_no")] if "article_no" in have else []), F.nullif(F.regexp_extract("text", r"(?:MADDE|Madde)\s+(\d+)", 1), F.lit("")), F.lit("unknown"))
    index = F.col("ordinal") if "ordinal" in have else F.lit(0)
    made = F.substring(F.sha2(F.concat_ws(":", col("source_file"), index.cast("string"), F.left("text", F.lit(64))), 256), 1, 24)
    return rows.withColumns({
        "chunk_id": F.coalesce(F.col("chunk_id"), made) if "chunk_id" in have else made, "source_file": col("source_file"), "source_type": col("source_type"), "article_number": article,
        "law_name": F.coalesce(*([F.col("law_name")] if "law_name" in have else []), F.regexp_replace(col("source_file"), r"\.[^.]*$", "")), "law_number": col("law_number"), "effective_date": col("effective_date"), "language": col("language", "tr"),
    })
