"""Pages as recognised text items: parsing, columns, reading order, lines, paragraphs, blocks, and what to do with a page.

An item is a struct (text, confidence, x0, y0, x1, y1). The items of one page are bounded by the page, so what depends on their order runs
page by page in a worker; the rest are expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import spatial

FLOOR = 0.01
ITEM = "struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>"
_PARAGRAPH = re.compile(r"^\s*(?:\(\d+\)|[a-zçğıöşü]\)|\d+[.)]\s|(?:ek\s+|geçici\s+)?madde\s*\d+)", re.IGNORECASE)


def items(raw: DataFrame) -> DataFrame:
    """raw (page, rec_texts, rec_scores, dt_polys) with `items`: one for each text that is not blank and not below FLOOR; boxes around the
    polygons, zeros where there is none; without a score the confidence is a half."""
    texts = F.coalesce("rec_texts", F.array().cast("array<string>"))
    side = lambda p, k, f: F.coalesce(f(F.transform(p, lambda q: F.get(q, F.lit(k)))), F.lit(0.0))

    def one(t, i):
        p, s = F.get("dt_polys", i), F.get("rec_scores", i)
        return F.struct(t.alias("text"), F.coalesce(s, F.lit(0.5)).alias("confidence"), side(p, 0, F.array_min).alias("x0"), side(p, 1, F.array_min).alias("y0"), side(p, 0, F.array_max).alias("x1"), side(p, 1, F.array_max).alias("y1"))

    made = F.transform(texts, one)
    return raw.withColumn("items", F.filter(made, lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & (x["confidence"] >= FLOOR)))


def parsed(raw_json: Column) -> Column:
    """struct(rec_texts, rec_scores, dt_polys) of an engine's JSON in any of the shapes in use, at the top or within overall_ocr_res."""
    inner = "dt_polys ARRAY<ARRAY<ARRAY<DOUBLE>>>, rec_polys ARRAY<ARRAY<ARRAY<DOUBLE>>>, rec_texts ARRAY<STRING>, texts ARRAY<STRING>, rec_scores ARRAY<DOUBLE>, scores ARRAY<DOUBLE>"
    got = F.from_json(raw_json, f"{inner}, overall_ocr_res STRUCT<{inner}>")
    deep = got["overall_ocr_res"]
    pick = lambda *names: F.coalesce(*(got[n] for n in names), *(deep[n] for n in names))
    return F.struct(pick("rec_texts", "texts").alias("rec_texts"), pick("rec_scores", "scores").alias("rec_scores"), pick("dt_polys", "rec_polys").alias("dt_polys"))


VISUAL = ("seal", "stamp", "signature", "image", "figure", "chart", "logo")


def kept_elements(layout: Column, threshold: float = 0.5) -> Column:
    """The layout elements (label, score, coordinate) at a confidence or above."""
    return F.filter(layout, lambda e: e["score"] >= threshold)


def visual_elements(layout: Column, threshold: float = 0.5) -> Column:
    """Those of them whose label names something to look at rather than to read."""
    return F.filter(kept_elements(layout, threshold), lambda e: F.lower(e["label"]).rlike("|".join(VISUAL)))


def first_of(pages: DataFrame, engines: list, cut, id: str = "page") -> DataFrame:
    """id, engine, text, confidence by the first engine that reads a page. engines: (name, function DataFrame -> DataFrame(id, text, confidence)); each only gets the
    pages that those before it left without text."""
    left, out = pages, None
    for name, read in engines:
        got = cut(read(left).where(F.trim(F.coalesce("text", F.lit(""))) != "").select(id, F.lit(name).alias("engine"), "text", "confidence"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(id), id, "left_anti")
    failed = left.select(id, F.lit(None).cast("string").alias("engine"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"))
    return failed if out is None else out.unionByName(failed)


def mean_confidence(items_: Column) -> Column:
    return F.when(F.size(items_) > 0, F.aggregate(items_, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(items_)).otherwise(0.0)


def low_ratio(items_: Column, threshold: float) -> Column:
    """The share of items below a confidence; 1 for a page without any."""
    return F.when(F.size(items_) > 0, F.size(F.filter(items_, lambda x: x["confidence"] < threshold)) / F.size(items_)).otherwise(1.0)


def decision(mean: Column, low: Column, has_items: Column, bad: Column, poor: Column, attempt: Column, max_attempts: int = 2, threshold: float = 0.6, fallback: bool = True, floor: float = 0.4) -> Column:
    """What to do with a page: accept, retry, fallback or give_up. bad: text is missing or damaged; poor: the image is."""
    good = has_items & (mean >= threshold) & (low < 0.3) & ~bad
    return (
        F.when(good, "accept").when(F.lit(fallback) & bad & (mean >= threshold), "fallback").when(attempt < max_attempts, "retry")
        .when(F.lit(fallback) & ((mean < floor) | bad | poor | ~has_items | (mean < threshold) | (low >= 0.3)), "fallback").otherwise("give_up")
    )


def page_status(pages: DataFrame, id: str = "doc_id", ok: str = "ok") -> DataFrame:
    """id, status: failed, partial or complete, from a flag for each page."""
    good = F.count_if(F.col(ok))
    return pages.groupBy(id).agg(F.count("*").alias("pages"), good.alias("good")).select(id, F.when(F.col("good") == 0, "failed").when(F.col("good") < F.col("pages"), "partial").otherwise("complete").alias("status"))


def column_gap(each: DataFrame, page: str = "page") -> DataFrame:
    """page, gap, split of exploded items (page, x0, x1): the widest gap between the sorted middles of the narrow ones, and its middle."""
    width = F.max("x1").over(Window.partitionBy(page))
    narrow = each.withColumn("w", width).where(F.col("x1") - F.col("x0") < 0.55 * F.col("w")).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    after = narrow.withColumn("n", F.lead("c").over(Window.partitionBy(page).orderBy("c")))
    return after.where("n IS NOT NULL").groupBy(page).agg(F.max_by(F.struct((F.col("n") - F.col("c")).alias("gap"), ((F.col("n") + F.col("c")) / 2).alias("split")), F.struct(F.col("n") - F.col("c"), -F.col("c"))).alias("g")).select(page, "g.gap", "g.split")


#: What counts as two columns, and as one line.
SLIM, LEAST_WIDTH, LEAST_ITEMS, LEAST_GAP, LEAST_SIDE, LEAST_OVERLAP = 0.55, 80, 12, 0.14, 4, 0.45
SAME_LINE, SAME_MIDDLE, LEAST_HEIGHT, PARAGRAPH_GAP, LEAST_PARAGRAPH_GAP = 0.5, 0.38, 8.0, 0.85, 10.0
CLAUSE = r"^\s*(?:\(\d+\)|[a-zçğıöşü]\)|\d+[.)]\s|(?i:(?:ek\s+|geçici\s+)?madde\s*\d+))"


def ordered(each: DataFrame, page: str = "page") -> DataFrame:
    """Items (page, item, x0, y0, x1, y1 ...) as rows with band and place, both from 0 on, in reading order: two columns one after the other where a page has two, between the rows of
    full width in their place; else from the top. Windows over a page's items, which the page bounds."""
    whole = Window.partitionBy(page)
    middle, slim = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0") < SLIM * F.col("__width")
    rows = each.withColumns({"__width": F.max("x1").over(whole), "__n": F.count("*").over(whole), "__most": F.max(F.greatest(*(F.abs(k) for k in ("x0", "y0", "x1", "y1")))).over(whole)}).withColumn("__slim", slim)
    # the widest gap between neighbouring middles of slim items, the leftmost of equal ones
    rows = rows.withColumn("__mid", F.when(F.col("__slim"), middle))
    after = F.lead("__mid").over(Window.partitionBy(page, "__slim").orderBy("__mid"))
    rows = rows.withColumn("__gap", F.when(F.col("__slim"), after - F.col("__mid")))
    best = F.max(F.when(F.col("__gap").isNotNull(), F.struct(F.col("__gap").alias("gap"), (-F.col("__mid")).alias("left")))).over(whole)
    rows = rows.withColumn("__best", best).withColumn("__right", F.col("__mid") >= (2 * -F.col("__best.left") + F.col("__best.gap")) / 2)
    side = lambda f, on: f(F.when(F.col("__slim") & (F.col("__right") == on[0]), on[1])).over(whole)
    for k, right in (("l", False), ("r", True)):
        rows = rows.withColumns({f"__{k}n": side(F.count, (right, F.lit(1))), f"__{k}top": side(F.min, (right, F.col("y0"))), f"__{k}end": side(F.max, (right, F.col("y1")))})
    least = F.least(F.col("__lend") - F.col("__ltop"), F.col("__rend") - F.col("__rtop"))
    both = F.least("__lend", "__rend") - F.greatest("__ltop", "__rtop")
    two = (F.col("__width") >= LEAST_WIDTH) & (F.col("__n") >= LEAST_ITEMS) & (F.col("__ln") + F.col("__rn") >= LEAST_ITEMS) & (F.col("__best.gap") >= LEAST_GAP * F.col("__width")) & (F.least("__ln", "__rn") >= LEAST_SIDE) & (least > 0) & (both >= LEAST_OVERLAP * least)
    rows = rows.withColumn("__two", F.coalesce(two, F.lit(False)))
    # rows of full width in their order; an item comes before the first of them whose middle is not above the item's end
    full = ~F.col("__slim")
    rows = rows.withColumn("__row", F.when(full, F.row_number().over(Window.partitionBy(page, "__slim").orderBy("y0", "item"))))
    reach = F.max(F.when(full, (F.col("y0") + F.col("y1")) / 2)).over(Window.partitionBy(page, "__slim").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__at", F.when(full, reach).otherwise(F.col("y1")))
    ahead = Window.partitionBy(page).orderBy("__at", F.when(full, 1).otherwise(0), "__row").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__before", F.when(full, F.col("__row")).otherwise(F.coalesce(F.min("__row").over(ahead), F.lit(1 << 30))))
    part = F.when(full, 2).when(F.col("__right"), 1).otherwise(0)
    bare = F.col("__most") <= 1  # items without places stay as they come
    key = F.when(bare | ~F.col("__two"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.col("__before").alias("a"), part.alias("b")))
    rows = rows.withColumns({"__key": key, "__y": F.when(bare, 0.0).otherwise(F.col("y0")), "__x": F.when(bare, 0.0).otherwise(F.col("x0"))})
    rows = rows.withColumns({"band": F.dense_rank().over(Window.partitionBy(page).orderBy("__key")) - 1, "place": F.row_number().over(Window.partitionBy(page).orderBy("__key", "__y", "__x", "item")) - 1})
    return rows.select(*each.columns, "band", "place")


def lined(each: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """Items as rows, with band, place and line: in each band from the top, an item begins a line unless it overlaps the item before it in height, its middle is near that one's, and
    it lies beside it; a numbered clause always begins one. Items without text are left out."""
    rows = ordered(each.where(F.trim(F.coalesce(text, F.lit(""))) != ""), page)
    w = Window.partitionBy(page).orderBy("place")
    before = {k: F.lag(k).over(w) for k in ("x0", "x1", "y0", "y1", "band")}
    rows = rows.withColumns({f"__{k}": c for k, c in before.items()})
    tall, other = F.greatest(F.lit(LEAST_HEIGHT), F.col("y1") - F.col("y0")), F.greatest(F.lit(LEAST_HEIGHT), F.col("__y1") - F.col("__y0"))
    meets = F.least("y1", "__y1") - F.greatest("y0", "__y0") >= SAME_LINE * F.least(tall, other)
    level = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("__y0") + F.col("__y1")) / 2) <= SAME_MIDDLE * F.greatest(tall, other)
    beside = F.least("x1", "__x1") - F.greatest("x0", "__x0") <= 0.3 * F.least(F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("__x1") - F.col("__x0")))
    same = (F.col("band") == F.col("__band")) & meets & level & beside & ~F.col(text).rlike(CLAUSE)
    rows = rows.withColumn("line", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.select(*each.columns, "band", "place", F.col("line").cast("int").alias("line"))


def paragraph_rows(each: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, paragraph (from 0 on), lines, text of the page's paragraphs: a new one begins in another band, after a gap wider than most of a line's
    usual (median) height, or at a numbered clause. Lines by lag and running sums, no code of a page's own."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("x0", "place", text))), lambda x: x[text])
    line = lined(each, page, text).groupBy(page, "line").agg(F.min("band").alias("band"), F.min("y0").alias("top"), F.max("y1").alias("end"), F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+", " ")).alias("said"))
    usual = F.greatest(F.lit(PARAGRAPH_GAP) * F.median(F.greatest(F.lit(LEAST_HEIGHT), F.col("end") - F.col("top"))).over(Window.partitionBy(page)), F.lit(LEAST_PARAGRAPH_GAP))
    w = Window.partitionBy(page).orderBy("line")
    rows = line.withColumns({"__usual": usual, "__end": F.lag("end").over(w), "__band": F.lag("band").over(w)})
    new = F.col("__band").isNull() | (F.col("band") != F.col("__band")) | (F.col("top") - F.col("__end") >= F.col("__usual")) | F.col("said").rlike(CLAUSE)
    rows = rows.withColumn("paragraph", (F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n")
    return rows.groupBy(page, "paragraph").agg(F.count("*").alias("lines"), joined.alias("text"))


def reading_order(found: list[dict]) -> list[list[dict]]:
    """The items of a page in bands: two columns one after the other where there are two, full-width rows in their place, else one band."""
    if not found or all(max(abs(i[k]) for k in ("x0", "y0", "x1", "y1")) <= 1 for i in found):
        return [found] if found else []
    by_place = lambda part: sorted(part, key=lambda i: (i["y0"], i["x0"]))
    width = max(i["x1"] for i in found)
    slim = [i for i in found if i["x1"] - i["x0"] < 0.55 * width]
    if width < 80 or min(len(found), len(slim)) < 12:
        return [by_place(found)]
    middle = lambda i: (i["x0"] + i["x1"]) / 2
    mids = sorted(map(middle, slim))
    gap, at = max(((b - a, (a + b) / 2) for a, b in zip(mids, mids[1:], strict=False)), key=lambda g: g[0])
    left, right = [i for i in slim if middle(i) < at], [i for i in slim if middle(i) >= at]
    if gap < 0.14 * width or min(len(left), len(right)) < 4:
        return [by_place(found)]
    tops, ends = [min(i["y0"] for i in s) for s in (left, right)], [max(i["y1"] for i in s) for s in (left, right)]
    least = min(e - t for t, e in zip(tops, ends, strict=True))
    if least <= 0 or min(ends) - max(tops) < 0.45 * least:
        return [by_place(found)]
    bands, rest = [], [left, right]
    for row in sorted((i for i in found if i["x1"] - i["x0"] >= 0.55 * width), key=lambda i: i["y0"]):
        y = (row["y0"] + row["y1"]) / 2
        for k in (0, 1):
            above = [i for i in rest[k] if i["y1"] <= y]
            rest[k] = [i for i in rest[k] if i["y1"] > y]
            if above:
                bands.append(by_place(above))
        bands.append([row])
    return bands + [by_place(s) for s in rest if s]


def _shares_line(item: dict, line: list[dict]) -> bool:
    for o in line:
        if min(item["x1"], o["x1"]) - max(item["x0"], o["x0"]) > 0.3 * min(max(1.0, item["x1"] - item["x0"]), max(1.0, o["x1"] - o["x0"])):
            return False
    top, end = min(o["y0"] for o in line), max(o["y1"] for o in line)
    tall, line_tall = max(8.0, item["y1"] - item["y0"]), max(8.0, end - top)
    if min(item["y1"], end) - max(item["y0"], top) < 0.5 * min(tall, line_tall):
        return False
    return abs((item["y0"] + item["y1"]) / 2 - (top + end) / 2) <= 0.38 * max(tall, line_tall)


def lines(found: list[dict]) -> list[list[dict]]:
    """The items as visual lines: side by side, never one above the other; a numbered clause begins a line."""
    out: list[list[dict]] = []
    for item in (i for band in reading_order(found) for i in band):
        if not item["text"].strip():
            continue
        host = None if _PARAGRAPH.match(item["text"].strip()) else next((x for x in out[:-5:-1] if _shares_line(item, x)), None)
        if host is None:
            out.append([item])
        else:
            host.append(item)
    for x in out:
        x.sort(key=lambda i: i["x0"])
    return sorted(out, key=lambda x: (min(i["y0"] for i in x), min(i["x0"] for i in x)))


def paragraphs(found: list[dict]) -> list[tuple[str, list[dict]]]:
    """(text, items) of the page's paragraphs: a new one begins after a wide gap or at a numbered clause."""
    if found and all(max(abs(i[k]) for k in ("x0", "y0", "x1", "y1")) <= 1 for i in found):
        return [(i["text"].strip("\n"), [i]) for i in found if i["text"].strip("\n")]
    rows = lines(found)
    if not rows:
        return []
    heights = sorted(max(8.0, max(i["y1"] for i in x) - min(i["y0"] for i in x)) for x in rows)
    mid = len(heights) // 2
    gap = max(0.85 * (heights[mid] if len(heights) % 2 else (heights[mid - 1] + heights[mid]) / 2), 10.0)
    out: list[list[list[dict]]] = []
    end = None
    for x in rows:
        text = " ".join(" ".join(i["text"].split()) for i in x).strip()
        if not out or min(i["y0"] for i in x) - end >= gap or _PARAGRAPH.match(text):
            out.append([])
        out[-1].append(x)
        end = max(i["y1"] for i in x)
    render = lambda x: " ".join(" ".join(i["text"] for i in x).split())
    return [("\n".join(render(x) for x in part), [i for x in part for i in x]) for part in out]


def page_text(pages: DataFrame, items_: str = "items") -> DataFrame:
    """pages with `text`: paragraphs in reading order, empty lines between them. One page a call in the worker."""

    @F.pandas_udf("string")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda found: "\n\n".join(t for t, _ in paragraphs([dict(i) for i in found] if found is not None else [])).strip())

    return pages.withColumn("text", join(F.col(items_).cast(f"array<{ITEM}>")))


def blocks(each: DataFrame, layout: DataFrame, page: str = "page") -> DataFrame:
    """page, block, item: every item (page, item, box) with the first layout element (page, block, box), from the top, that it overlaps;
    block is null for items that are in none. An item is used once."""
    elements = layout.select(page, "block", F.col("box").alias("around"), F.col("box.y0").alias("top"), F.col("box.x0").alias("side"))
    return spatial.first_overlap(each, elements, [page], "item", "box", "block", "around", ["top", "side"]).select(page, "block", "item")


def union_box(boxes: Column) -> Column:
    """struct(x0, y0, x1, y1) around all boxes; null where all are zeros."""
    side = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    made = F.struct(side("x0", F.array_min).alias("x0"), side("y0", F.array_min).alias("y0"), side("x1", F.array_max).alias("x1"), side("y1", F.array_max).alias("y1"))
    return F.when(F.greatest(*(F.abs(made[k]) for k in ("x0", "y0", "x1", "y1"))) > 1, made)


def overlap(a: str, b: str, least: int = 1) -> int:
    """The most characters, `least` or more, that end a and begin b; 0 where there are none. Ends and beginnings of all lengths are compared by hashes at once, and
    those that agree character by character."""
    n = min(len(a), len(b))
    if n < least:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1) for t in (a[-n:], b[:n]))
    powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers)])
    ends = run[-1] - run[:-1]  # the last n - i characters of a, by powers from i on
    starts = np.cumsum(y * powers)[::-1]  # the first n - i of b, by powers from 0 on
    shift = np.concatenate([np.ones(1, np.uint64), powers[:-1]])
    for i in np.flatnonzero(ends == starts * shift).tolist():
        if n - i < least:
            break
        if a[-(n - i) :] == b[: n - i]:
            return n - i
    return 0


def merged_text(ocr: str, vision: str, least: float = 0.5) -> str:
    """One text of a recognised page and a vision model's reading of it: the longer one where the other begins or ends it, a
    stitched one where the end of the first is the start of the second, marks restored from the model, else the recognised one."""
    ocr, vision = (ocr or "").strip(), (vision or "").strip()
    if not ocr or not vision:
        return ocr or vision
    plain = lambda t: t.translate(str.maketrans("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")).lower()
    a, b = plain(ocr), plain(vision)
    if a == b:
        return vision
    if b.startswith(a) or b.endswith(a):
        return vision
    if a.startswith(b) or a.endswith(b):
        return ocr
    after, before = overlap(a, b, 12), overlap(b, a, 12)
    if after or before:
        return ocr + vision[after:] if after >= before else vision + ocr[before:]
    words = set(a.split())
    shared = len(words & set(b.split())) / max(1, len(words))
    return vision if shared >= least and len(vision) > len(ocr) else ocr


def merged(pages: DataFrame, ocr: str = "text", vision: str = "vision") -> DataFrame:
    """pages with the two readings merged in `merged`."""

    @F.pandas_udf("string")
    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merged_text(x, y) for x, y in zip(a, b, strict=True)])

    return pages.withColumn("merged", both(ocr, vision))
