"""Personal data: candidate spans, judged by gradient-boosted trees, and redaction. Native expressions only.

Base spans are what the patterns of email, ip, card and phone find and their checks accept; they always stay. Besides,
high-recall generators propose spans of all four kinds, overlapping each other and the base ones: every window of digit groups of a run of
numbers, as each kind that its digits allow, and mail-like spans, cut after each label of the domain. So what a base pattern takes
together and then drops (two cards, or a phone number before an address) is proposed in its parts. Every candidate has format
features (digits, groups, separators, check digit ...) and context features (neighbouring characters, cue words before it).
The trees learn from all candidates of the corpus: base spans are positive; candidates that touch no base span and have the
shape of no kind are negative; those that touch one, and well-formed ones (a phone number without its plus, a spelt-out
at sign, half of a dropped match), are unlabelled. The features are small integers, so the corpus is aggregated to counts of their combinations,
which is all that the driver sees. A fifth of the documents, by a hash of their id, sets each kind's threshold: the lowest one with a
precision of `precision`. All candidates are scored; of those above their kind's threshold that overlap, the ones beside base spans come first,
then the higher score, then the longer one. Candidates inside a base span add nothing.

Null and empty texts have no spans. Repeated rows give repeated results; ties in start go by kind (email, ip, card, phone). Without
candidates, as in an empty table, nothing is learned or added. Very long texts are searched whole. redact() passes extra columns through, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import columns_free, documents

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract, in a spelling without backtracking: possessive loops, and runs are entered at their first
# character only, or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"\+?\(?[0-9][0-9\x20().+-]{5,}[0-9]",
    "mail": r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
}
#: Most digits of a window.
MOST = 19
CUES = r"(?i)(?:tel|phone|mobile|fax|call|card|visa|account|iban|mail|contact|address)[^a-z0-9]{0,8}$"
_SPAN = "array<struct<start:int,end:int,said:string,before:string,after:string>>"
_NAMED = "array<struct<start:int,order:int,kind:string,end:int,said:string,before:string,after:string>>"


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """All matches from the left with their code-point places, and up to 24 characters before and one after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)
    n = F.size(found)
    rows = F.arrays_zip(found.alias("m"), F.slice(rest, 1, n).alias("b"), F.slice(rest, 2, n).alias("a"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("said"), F.right(x["b"], F.lit(24)).alias("before"), F.left(x["a"], F.lit(1)).alias("after")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.when(gate, F.aggregate(rows, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    doubled = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def accepted(kind: str, s: Column) -> Column:
    """The check of a kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return s.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    d = digits(s)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _gates(text: Column) -> dict[str, Column]:
    number = text.rlike("[0-9]")
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": number, "phone": text.contains("+"), "number": number, "mail": text.rlike(r"(?i)@|[(\[{]at[)\]}]")}


def _named(arr: Column, kind: str) -> Column:
    """Spans with their kind and its place in KINDS."""
    order = KINDS.index(kind)
    return F.transform(arr, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), *(x[c].alias(c) for c in ("said", "before", "after"))))


def base_spans(text: Column) -> Column:
    """array<struct<start, order, kind, end, said, before, after>> of the base spans, by start and kind."""
    gates = _gates(text)

    def of(kind: str) -> Column:
        return _named(F.filter(spans(text, PATTERNS[kind], gates[kind]), lambda x: accepted(kind, x["said"])), kind)

    return F.sort_array(F.concat(*map(of, KINDS)))


def _windows(run: Column, parts: Column) -> Column:
    """Sub-spans of a run: from the start of any of its parts (p: start of the part, q: of its digits) to the end (e) of the same or a later one, with all
    the kinds each could be; n: number of digits."""
    size = F.size(parts)

    def ends(g, i):
        zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"), F.array().cast("array<struct<q:int,p:int,e:int,n:int>>").alias("out"))

        def step(acc, h):
            n = acc["n"] + h["n"]
            # a plus starts another number
            on = acc["on"] & (n <= MOST) & ((h["p"] == g["p"]) | ~h["plus"])
            one = F.array(F.struct(g["q"].alias("q"), g["p"].alias("p"), h["e"].alias("e"), n.alias("n")))
            return F.struct(n.alias("n"), on.alias("on"), F.when(on & (n >= 4), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.slice(parts, i + 1, F.least(F.lit(MOST), size - i)), zero, step, lambda acc: acc["out"])

    def kinds(w):
        bare = F.substring(run["said"], w["q"] + 1, w["e"] - w["q"])

        def as_(kind, start, fits):
            said = F.substring(run["said"], start + 1, w["e"] - start)
            before = F.right(F.concat(run["before"], F.substring(run["said"], F.lit(1), start)), F.lit(24))
            after = F.left(F.concat(F.substring(run["said"], w["e"] + 1, F.lit(1)), run["after"]), F.lit(1))
            span = F.struct((run["start"] + start).alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), (run["start"] + w["e"]).alias("end"), said.alias("said"), before.alias("before"), after.alias("after"))
            return F.when(fits, F.array(span)).otherwise(F.array().cast(_NAMED))

        return F.concat(as_("ip", w["q"], bare.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")), as_("card", w["q"], w["n"] >= 12), as_("phone", w["p"], w["n"].between(7, 15)))

    return F.flatten(F.transform(F.flatten(F.transform(parts, ends)), kinds))


def _numbers(run: Column) -> Column:
    """The windows of the digit groups of a run."""
    said = run["said"]
    group = r"\+?\(?[0-9]+"
    found = F.arrays_zip(F.regexp_extract_all(said, F.lit(group), F.lit(0)).alias("m"), F.split(said, group, -1).alias("b"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<p:int,q:int,e:int,n:int,plus:boolean>>").alias("out"))

    def step(acc, x):
        p = acc["at"] + F.length(x["b"])
        e = p + F.length(x["m"])
        n = F.length(digits(x["m"]))
        one = F.array(F.struct(p.alias("p"), (e - n).alias("q"), e.alias("e"), n.alias("n"), x["m"].startswith("+").alias("plus")))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out")))

    groups = F.aggregate(found, zero, step, lambda acc: acc["out"])
    # through a one-element array, so that the groups are found once
    return F.flatten(F.transform(F.array(groups), lambda g: _windows(run, g)))


def _mails(x: Column) -> Column:
    """A mail-like span, and what it is when cut after each of its domain's first labels."""
    head = F.regexp_extract(x["said"], r"(?i)^[A-Za-z0-9._%+-]+\x20?(?:@|[(\[{]at[)\]}])\x20?", 0)
    labels = F.split(F.substring(x["said"], F.length(head) + 1, F.length(x["said"])), r"\.")

    def cut(label, i):
        said = F.concat(head, F.array_join(F.slice(labels, F.lit(1), i + 1), "."))
        end = F.length(said)
        after = F.left(F.concat(F.substring(x["said"], end + 1, F.lit(1)), x["after"]), F.lit(1))
        return F.struct(x["start"].alias("start"), F.lit(0).alias("order"), F.lit("email").alias("kind"), (x["start"] + end).alias("end"), said.alias("said"), x["before"].alias("before"), after.alias("after"))

    return F.transform(labels, cut)


def touches(x: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def proposals(text: Column, base: Column) -> Column:
    """Generated spans of all kinds, of the same type, which overlap each other and may overlap base spans; those inside a base span are left out, as it stays anyway."""
    gates = _gates(text)
    each = F.concat(F.flatten(F.transform(spans(text, GENERATORS["number"], gates["number"]), _numbers)), F.flatten(F.transform(spans(text, GENERATORS["mail"], gates["mail"]), _mails)))
    return F.filter(each, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))


def _neighbour(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


FEATURES = ("order", "digits", "letters", "groups", "parens", "hyphens", "blanks", "dots", "check", "left", "right", "cue", "at")


def features(x: Column) -> dict[str, Column]:
    """Small integers that describe a span. Its plus is none of them, as that would only repeat the phone pattern."""
    said = x["said"]
    d = digits(said)
    return {
        "order": x["order"],
        "digits": F.least(F.length(d), F.lit(20)),
        "letters": F.least(F.regexp_count(said, F.lit("[A-Za-z]")), F.lit(3)),
        "groups": F.least(F.regexp_count(said, F.lit("[0-9]+")), F.lit(6)),
        "parens": F.when(said.contains("("), F.when(said.contains(")"), 1).otherwise(2)).otherwise(0),
        "hyphens": F.least(F.regexp_count(said, F.lit("-")), F.lit(3)),
        "blanks": F.least(F.regexp_count(said, F.lit(" ")), F.lit(3)),
        "dots": F.least(F.regexp_count(said, F.lit(r"\.")), F.lit(4)),
        "check": F.when(x["order"] == KINDS.index("ip"), accepted("ip", said).cast("int")).when(F.length(d).between(12, 19), luhn(d).cast("int")).otherwise(2),
        "left": _neighbour(F.right(x["before"], F.lit(1))),
        "right": _neighbour(x["after"]),
        "cue": x["before"].rlike(CUES).cast("int"),
        "at": (said.contains("@") | said.rlike(r"(?i)[(\[{]at[)\]}]")).cast("int"),
    }


def well_formed(x: Column) -> Column:
    """Shapes that a person would read as an address, a card or a phone number, and addresses cut short: without a label where no base span holds them."""
    said = x["said"]
    phone = (said.rlike(r"^\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}$") & F.length(digits(said)).between(9, 12)) | (said.startswith("+") & accepted("phone", said))
    card = said.rlike(r"^(?:[0-9]{12,19}|[0-9]{4}(?:[\x20.-]{1,2}[0-9]{4}){3}|[0-9]{4}[\x20.-]{1,2}[0-9]{6}[\x20.-]{1,2}[0-9]{5})$") & accepted("card", said)
    return F.when(x["order"] == 0, said.rlike(r"\.[A-Za-z]{2,}$") | (x["after"] == ".")).when(x["order"] == 1, accepted("ip", said)).when(x["order"] == 2, card).otherwise(phone)


class Trees:
    """Boosted trees of depth two over integer features; the score is a log odds."""

    def __init__(self, start: float, trees: list, thresholds: dict[int, float]):
        self.start, self.trees, self.thresholds = start, trees, thresholds

    def value(self, row) -> float:
        return self.start + sum(t[3 + 2 * (row[t[0]] > t[1]) + (row[t[2][row[t[0]] > t[1]][0]] > t[2][row[t[0]] > t[1]][1])] for t in self.trees)

    def expression(self, f: dict[str, Column]) -> Column:
        col = [f[k] for k in FEATURES]
        parts = [F.lit(self.start)]
        for a, cut, ((b, bcut), (c, ccut)), ll, lr, rl, rr in self.trees:
            parts.append(F.when(col[a] <= cut, F.when(col[b] <= bcut, ll).otherwise(lr)).otherwise(F.when(col[c] <= ccut, rl).otherwise(rr)))
        return reduce(lambda p, q: p + q, parts)


def boost(table: list[tuple[tuple[int, ...], int, float]], rounds: int = 20, rate: float = 0.4) -> tuple[float, list]:
    """Newton boosting on (features, label, weight)."""
    pos = sum(w for _, y, w in table if y)
    neg = sum(w for _, y, w in table if not y)
    start = math.log((pos + 0.5) / (neg + 0.5))
    score = [start] * len(table)
    cuts = [(k, v) for k in range(len(FEATURES)) for v in sorted({x[k] for x, _, _ in table})[:-1]] or [(0, 0)]
    trees = []

    def leaf(rows, g, h):
        return -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)

    def best(rows, g, h):
        top, at = -1.0, cuts[0]
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for k in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in rows:
                e = by.setdefault(table[i][0][k], [0.0, 0.0])
                e[0] += g[i]
                e[1] += h[i]
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1)
                if gain > top + 1e-12:
                    top, at = gain, (k, v)
        return at

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [w * (q - y) for (_, y, w), q in zip(table, p, strict=True)]
        h = [w * q * (1 - q) for (_, _, w), q in zip(table, p, strict=True)]
        a, cut = best(range(len(table)), g, h)
        sides = [[i for i, t in enumerate(table) if t[0][a] <= cut], [i for i, t in enumerate(table) if t[0][a] > cut]]
        splits = tuple(best(s, g, h) for s in sides)
        leaves = []
        for s, (b, bcut) in zip(sides, splits, strict=True):
            for part in ([i for i in s if table[i][0][b] <= bcut], [i for i in s if table[i][0][b] > bcut]):
                leaves.append(round(leaf(part, g, h), 9))
                for i in part:
                    score[i] += leaves[-1]
        trees.append((a, cut, splits, *leaves))
    return start, trees


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", precision: float = 0.99) -> Trees | None:
    """Learn from all candidates of docs; None without positive and negative ones."""
    base = docs.select((F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("__text")).where(F.col("__text").rlike(r"[0-9@]|(?i)[(\[{]at[)\]}]"))
    base = base.withColumn("__base", base_spans(F.col("__text")))
    base = base.select("held", F.col("__base"), proposals(F.col("__text"), F.col("__base")).alias("__more"))
    label = lambda arr, y: F.transform(arr, lambda x: F.struct(x.alias("x"), y(x).alias("y")))
    each = base.select("held", F.explode(F.concat(label(F.col("__base"), lambda x: F.lit(1)), label(F.col("__more"), lambda x: F.when(touches(x, F.col("__base")) | well_formed(x), -1).otherwise(0)))).alias("c"))
    f = features(F.col("c.x"))
    rows = each.select("held", F.col("c.y").alias("y"), *(f[k].cast("int").alias(k) for k in FEATURES)).where("y >= 0")
    # combinations of small integers: their number has a bound that does not depend on the corpus
    got = [(tuple(r[k] for k in FEATURES), r["y"], bool(r["held"]), float(r["n"])) for r in rows.groupBy("held", "y", *FEATURES).agg(F.count("*").alias("n")).collect()]
    got.sort()
    learn = [(x, y, n) for x, y, held, n in got if not held] or [(x, y, n) for x, y, _, n in got]
    if {y for _, y, _ in learn} != {0, 1}:
        return None
    trees = Trees(*boost(learn), {})
    for k in range(len(KINDS)):
        scored = sorted(((trees.value(x), y, n) for x, y, held, n in got if held and x[0] == k), reverse=True)
        good = all_ = 0.0
        least = math.inf
        for i, (s, y, n) in enumerate(scored):
            all_, good = all_ + n, good + y * n
            if good >= precision * all_ and (i + 1 == len(scored) or scored[i + 1][0] < s):
                least = (s + scored[i + 1][0]) / 2 if i + 1 < len(scored) else -math.inf
        trees.thresholds[k] = max(least, 0.0)
    return trees


def detect(docs: DataFrame, trees: Trees | None, text: str = "text", base: str = "pii_base", all: str = "pii_spans") -> DataFrame:
    """docs with two arrays of structs (start, order, kind, end): the base spans, and all spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    (found_base,) = columns_free(docs, "__base")
    out = docs.withColumn(found_base, base_spans(whole))
    place = lambda arr: F.transform(arr, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans_ = place(F.col(found_base))
    if trees and any(math.isfinite(v) for v in trees.thresholds.values()):

        limit = lambda x: reduce(lambda c, k: F.when(x["order"] == k, trees.thresholds[k]).otherwise(c), [k for k, v in trees.thresholds.items() if math.isfinite(v)], F.lit(math.inf))
        # step by step, as an expression inside a lambda is evaluated wherever it is named
        found = F.transform(proposals(whole, F.col(found_base)), lambda x: F.struct(x.alias("x"), F.struct(*(v.cast("int").alias(k) for k, v in features(x).items())).alias("f")))
        found = F.transform(found, lambda c: F.struct(c["x"].alias("x"), trees.expression({k: c["f"][k] for k in FEATURES}).alias("score")))
        found = F.filter(found, lambda c: c["score"] >= limit(c["x"]))
        # the best first: beside the base spans, by score, the longer ones
        rank = lambda c: F.struct(touches(c["x"], F.col(found_base)).alias("t"), (-F.round(c["score"], 9)).alias("s"), (c["x"]["start"] - c["x"]["end"]).alias("l"), *(c["x"][k].alias(k) for k in ("start", "order", "kind", "end")))
        ranked = F.sort_array(F.transform(found, rank))
        none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
        kept = F.aggregate(place(ranked), none, lambda acc, x: F.when(touches(x, acc), acc).otherwise(F.concat(acc, F.array(x))))
        spans_ = F.sort_array(F.concat(spans_, kept))
    return out.withColumns({all: spans_, base: place(F.col(found_base))}).drop(found_base)


def listed(arr: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are replaced together, under the first one's kind. Null stays null."""
    first, every = columns_free(docs, "__first", "__every")
    found = detect(docs, trees, text, first, every)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        piece = F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def whole(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))

    clean = F.when(F.size(every) > 0, F.aggregate(F.col(every), zero, step, whole)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = detect(docs, fit(docs))
    count = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
