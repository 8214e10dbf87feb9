"""Text functions as Column expressions: normalising, folding, tokenising, cleaning, language and OCR checks.

Order matters for Turkish: words are cut from the original text first and lower-cased and folded after, because lower-casing the
dotted capital I yields two characters. All functions give null for null unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word character, and the words that carry no meaning of their own.
TOKEN = "[0-9A-Za-zÀ-ÖØ-öø-ÿĞğİıŞşÇçÜüÖö]+"
NO_TOKEN = "[^" + TOKEN[1:]
STOPWORDS = (
    "ve", "ile", "bir", "bu", "için", "icin", "olan", "olarak", "veya", "de", "da", "ki", "mi", "mı", "mu", "mü", "the", "and", "or", "of",
    "to", "in", "on", "göre", "gore", "her", "gibi", "üzere", "uzere", "yahut",
)
ROUTING_TOKEN = "[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]+"
ROUTING_STOPWORDS = (
    "ve", "veya", "ile", "bu", "bir", "de", "da", "için", "olan", "olarak", "gibi", "ise", "ancak", "fakat", "çok", "daha", "en", "her", "tüm",
    "mi", "mu", "mı", "mü", "ki", "ne", "ya", "hem", "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "with", "this",
    "that", "be", "as", "by", "at",
)
TITLE_WORDS = ("kanunu", "yonetmeligi", "yonetmelik", "tebligi", "teblig", "tuzugu", "tuzuk", "sayili")
_FOLD_FROM, _FOLD_TO = "çğıöşüÇĞİÖŞÜ̇", "cgiosuCGIOSU"
_BLANK = r"[ \t\n\x0b\f\r]+"


def fold(text: Column) -> Column:
    """Turkish letters as their ASCII twins, and combining dots dropped."""
    return F.translate(text, _FOLD_FROM, _FOLD_TO)


def normal(text: Column) -> Column:
    """Folded and lower-cased, for matching phrases; null is empty."""
    return fold(F.lower(fold(F.coalesce(text, F.lit("")))))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, and none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def tokens(text: Column, min_len: int = 1, drop_stopwords: bool = False) -> Column:
    """Folded lower-case words in order; null has none."""
    # what is no part of a word goes first, as lower case could make it one; then the whole text is folded at once
    whole = fold(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NO_TOKEN, " ")))
    words = F.array_remove(F.split(whole, " "), "")
    if min_len > 1:
        words = F.filter(words, lambda w: F.length(w) >= min_len)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS)) if drop_stopwords else words


def routing_tokens(text: Column) -> Column:
    """Words for department scoring: lower-cased, not folded, of two letters or more, without the routing stop words.

    The dotted capital I is made a plain one first, so that its words stay whole."""
    whole = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i")))
    return F.filter(F.regexp_extract_all(whole, F.lit(ROUTING_TOKEN), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*ROUTING_STOPWORDS))


def title_tokens(title: Column) -> Column:
    """Distinct meaningful words of a source's title: no numbers, no generic words, three letters or more."""
    return F.array_distinct(F.filter(tokens(fold(title), 3), lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*TITLE_WORDS)))


def normalize_whitespace(text: Column) -> Column:
    """Line ends as \\n, runs of blanks as one, at most one empty line between paragraphs, nothing around."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(text)


def strip(text: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def clean_text(text: Column) -> Column:
    """Without rules of dashes, page numbers on lines of their own, and with footnote marks pulled into their line."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n?\s*[—\-]{5,}\s*\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,4}(?:-\d{1,2})?\s*$", "")
    return normalize_whitespace(F.regexp_replace(text, r"\s*\((\d+)\)\s*\n", " ($1) "))


def token_estimate(text: Column) -> Column:
    """A model's tokens, guessed as a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("int")


def ocr_correct(text: Column) -> Column:
    """Straight quotes, single blanks, no blank before punctuation, numbers not broken by blanks."""
    text = F.translate(F.coalesce(text, F.lit("")), "“”‘’", "\"\"''")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), r"\s+([,.;:!?])", "$1")
    return strip(F.regexp_replace(text, r"(?<=[0-9])\s+(?=[0-9])", ""))


# Frequent words of Turkish letters, without marks, and letters that only it has.
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
TURKISH_WORDS = (
    "adres", "alinmistir", "ancak", "basvuru", "bildirim", "bir", "bulunmasi", "diger", "durumunda", "edinir", "edilir", "halinde", "icin",
    "ilgili", "islem", "kadar", "kapsaminda", "menusu", "odeme", "olarak", "poliçe", "police", "prim", "sigorta", "sozlesme", "taraf", "teminat",
    "tuketici", "uygulanir", "ve", "yapilan", "yazili", "yonetmelik",
)


def detect_language(text: Column, configured: str = "tr") -> Column:
    """struct(detected, confidence): Turkish by its letters, or by three of its frequent words, else English; the
    configured one at confidence 0 for texts without letters."""
    text = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    ratio = F.regexp_count(text, F.lit(f"[{TURKISH_LETTERS}]")) / letters
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+"), F.lit(0)))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, TURKISH_WORDS))))
    out = lambda name, p: F.struct(F.lit(name).alias("detected"), p.cast("double").alias("confidence"))
    by_letters = F.round(F.least(F.lit(0.99), 0.5 + ratio * 10), 2)
    by_words = F.least(F.lit(0.95), 0.55 + hits * 0.06)
    return F.when(letters == 0, out(configured, F.lit(0.0))).when(ratio > 0, out("tr", by_letters)).when(hits >= 3, out("tr", by_words)).otherwise(out("en", F.lit(0.6)))


# Stems whose marks an OCR engine tends to lose.
_ASCII_HINT = r"(?iu)\b(?:t[uü]ketici|s[iıi]rket|s[oö]zle[sş]me|y[oö]netmelik|bildirim|uyusmazl[iı]k|mahkemelere?|hukuk|mevzuat|h[uü]k[uü]m)\b"
_CAMEL = "^[A-Za-zÇĞİÖŞÜçğıöşü]*[A-ZÇĞİÖŞÜ][a-zçğıöşü]+[A-ZÇĞİÖŞÜ]"


def order_unreliable(text: Column) -> Column:
    """Whether numbered clauses stand within lines more often than at their start, as when columns were read across, or
    headings are glued to what follows."""
    lines = F.transform(F.split(text, "\n"), strip)
    at_start = F.size(F.filter(lines, lambda x: x.rlike(r"^\(\d+\)")))
    inside = F.size(F.filter(lines, lambda x: ~x.rlike(r"^\(\d+\)") & x.rlike(r"\S.+\(\d+\)")))
    glued, spaced = F.regexp_count(text, F.lit(r"(?i)Madde\s*\d+\s*-\s*\S{8,}")), F.regexp_count(text, F.lit(r"(?i)Madde\s+\d+\s*-\s+\S"))
    headings = (glued >= 2) & (spaced == 0) & ~F.left(text, F.lit(80)).contains(",") & text.rlike(r"(?i)Madde\s*\d+\S+\s+\(\d+\)")
    return ((inside >= 2) & (inside >= at_start)) | headings


def looks_corrupted(text: Column) -> Column:
    """Whether a page's text has lost Turkish letters, has clauses in the middle of lines, or words that are none."""
    text = F.coalesce(text, F.lit(""))
    lost = (F.regexp_count(text, F.lit(_ASCII_HINT)) >= 3) & (F.regexp_count(text, F.lit(f"[{TURKISH_LETTERS}]")) < 3)
    mixed = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S{10,}\s+\(\d+\)\s+\S{10,}"))) >= 2
    words = F.regexp_extract_all(text, F.lit("[A-Za-zÇĞİÖŞÜçğıöşü]{4,}"), F.lit(0))
    bad = F.size(F.filter(words, lambda w: w.rlike(_CAMEL) | ((F.length(w) >= 6) & ~w.rlike("[aeiouAEIOUıiöüİ]")))) >= 3
    return F.when(strip(text) == "", False).otherwise(lost | mixed | bad | order_unreliable(text))


_BLOCKS = ("title", "header", "paragraph", "text", "list", "table", "image", "footer", "seal", "signature", "figure", "chart")


def block_type(raw: Column) -> Column:
    """A layout label as one of the known block types."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    has = lambda *words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return (
        F.when(t.isin(*_BLOCKS), t).when(has("title", "heading"), "title").when(has("head"), "header").when(has("foot"), "footer").when(has("table"), "table")
        .when(has("seal", "stamp"), "seal").when(has("sign"), "signature").when(has("image", "figure", "picture"), "image").otherwise("unknown")
    )


def display_lines(text: Column) -> Column:
    """The stripped lines of a text that are not empty; escaped line ends count where there are no real ones."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    text = F.when(text.contains("\\n") & ~strip(text).contains("\n"), F.replace(text, F.lit("\\n"), F.lit("\n"))).otherwise(text)
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def article_blocks(text: Column) -> Column:
    """array<struct<number, lines>> of the articles that begin on lines of their own."""
    text = F.coalesce(text, F.lit(""))
    head = r"(?:^|\n)\s*(?:MADDE|Madde|مادة)\s*([0-9]+)\s*[-–—:.]?\s*"
    numbers = F.regexp_extract_all(text, F.lit(head), F.lit(1))
    bodies = F.split(text, head, -1)
    bodies = F.slice(bodies, F.greatest(F.size(bodies) - F.size(numbers) + 1, F.lit(1)), F.greatest(F.size(numbers), F.lit(0)))
    return F.zip_with(numbers, bodies, lambda n, b: F.struct(n.alias("number"), display_lines(b).alias("lines")))


def signature(text: Column, elements: Column | None = None) -> Column:
    """struct(has_signature, handwritten, names) from the text and the labels of the page's visual elements."""
    lines = display_lines(text)
    label = r"(?iu)^\s*(?:İmza|Imza|İMZA|توقيع)\s*[:：]?\s*$"
    tidy = lambda x: F.regexp_replace(x, r"^[ .\-]+|[ .\-]+$", "")
    inline = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?imu)\b(?:İmza|Imza|توقيع)\s*[:：]\s*(\S.+)$"), F.lit(1)), tidy)
    after = F.transform(F.filter(F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.when(a.rlike(label) & ~F.coalesce(b, F.lit("")).rlike(label), b)), lambda x: x.isNotNull()), tidy)
    names = F.filter(F.array_distinct(F.concat(inline, after)), lambda x: x != "")
    shown = F.transform(elements, F.lower) if elements is not None else F.array().cast("array<string>")
    seen = F.filter(shown, lambda x: x.rlike("sign|handwrit|imza"))
    has = (F.size(seen) > 0) | (F.size(inline) > 0) | F.exists(lines, lambda x: x.rlike(label))
    hint = F.coalesce(text, F.lit("")).rlike(r"(?iu)\b(el yazıs[ıi]|handwrit|imza\s*kontrol|islak\s*imza)\b")
    hand = F.exists(seen, lambda x: x.rlike("hand|yaz")) | (F.size(after) > 0) | (hint & has) | (has & (F.size(names) > 0))
    return F.struct(has.alias("has_signature"), hand.alias("handwritten"), names.alias("names"))


def table_cells(html: Column) -> Column:
    """array<struct<row, column, text>> of the cells of an HTML table, tags stripped."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    plain = lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", " "))
    cells = F.transform(rows, lambda r, i: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c, j: F.struct(i.alias("row"), j.alias("column"), plain(c).alias("text"))))
    return F.flatten(cells)


def table_grid(cells: Column) -> Column:
    """Cells as rows of equal length; what is missing is empty, of two cells at one place the later one stays."""
    size = lambda name: F.array_max(F.transform(cells, lambda c: c[name])) + 1
    at = lambda r, c: F.coalesce(F.try_element_at(F.filter(cells, lambda x: (x["row"] == r) & (x["column"] == c)), F.lit(-1))["text"], F.lit(""))
    grid = F.transform(F.sequence(F.lit(0), size("row") - 1), lambda r: F.transform(F.sequence(F.lit(0), size("column") - 1), lambda c: at(r, c)))
    return F.when(F.size(cells) > 0, grid).otherwise(F.array().cast("array<array<string>>"))


_SENTENCE = r"(?<=[.!?])\s+|\n+"


def without_repeats(text: Column, least: int = 50) -> Column:
    """Sentences of a text, empty lines between them, long ones only where they come first."""
    said = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), _SENTENCE), strip), lambda s: s != "")
    keyed = F.transform(said, lambda s: F.struct(s.alias("s"), squeeze(normal(s)).alias("k")))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        long = F.length(x["k"]) >= least
        again = long & F.array_contains(acc["seen"], x["k"])
        seen = F.when(long & ~again, F.concat(acc["seen"], F.array(x["k"]))).otherwise(acc["seen"])
        return F.struct(seen.alias("seen"), F.when(again, acc["out"]).otherwise(F.concat(acc["out"], F.array(x["s"]))).alias("out"))

    return F.aggregate(keyed, zero, step, lambda acc: F.array_join(acc["out"], "\n\n"))


def repeats_itself(text: Column) -> Column:
    """Whether dropping repeated sentences drops any."""
    count = lambda t: F.size(F.filter(F.split(strip(t), _SENTENCE), lambda s: strip(s) != ""))
    text = F.coalesce(text, F.lit(""))
    return count(without_repeats(text)) < count(text)


def layout_summary(labels: Column, at_most: int = 12) -> Column:
    """A prompt line that counts the kinds of a page's layout elements."""
    kinds = F.array_sort(F.array_distinct(labels))
    parts = F.transform(kinds, lambda k: F.concat(k, F.lit(" x"), F.size(F.filter(labels, lambda v: v == k)).cast("string")))
    return F.when(F.size(labels) > 0, F.array_join(F.slice(parts, 1, at_most), ", ")).otherwise("no layout elements")
