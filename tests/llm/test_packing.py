import random
import zlib

import numpy as np
import pytest

from lodestone.llm import bpe, packing

PATH = bpe.tokenizer_path()
TOK = bpe.load(PATH)
BITS = ["the", "ing", " ", "  ", "\n", "\t", "The", "DON'T", "'s", "it's", "1234", "!!", "...", "é", "É", "é", "ß", "ÿ", "µ", "ª", "×", "日本語", "　", "\xa0", "<|endoftext|>", "<|end", "👍🏽", "\x00", "\x1c", "\x85", "Ünïcödé", "ΣΑΣ", "İ", "ǅ", "ﬁ", "''", "'ll"]


def reference(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def texts(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_give_what_the_library_gives():
    words = packing.Words(PATH, cached=50, section=40)
    for some in (texts(300, 1), texts(300, 1), ["", "a" * 3000, "ab " * 900]):
        raw = [t.encode() for t in some]
        got = words.texts(b"".join(raw), np.cumsum([0, *map(len, raw)]))
        assert len(got) == len(some)
        for t, ids in zip(some, got, strict=True):
            assert ids.tolist() == reference(t), t


def bins(lengths, size):
    """Sequences of a plain best-fit decreasing packing."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=room.__getitem__)] -= x
        else:
            room.append(size - x)
    return len(room)


@pytest.mark.parametrize("name, make", [("uniform", lambda r: r.randint(1, 64)), ("small", lambda r: r.randint(1, 9)), ("skew", lambda r: r.choice([21, 21, 21, r.randint(1, 64)])), ("halves", lambda r: r.choice([32, 31, 33, 1]))])
def test_plan_uses_every_piece_and_no_more_sequences_than_best_fit(name, make):
    rng = random.Random(name)
    for n in (0, 1, 2, 30, 700):
        lengths = [make(rng) for _ in range(n)]
        plan = packing.plan(np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int))
        used = [x for chosen, times in plan for _ in range(times) for x in chosen]
        assert sorted(used) == sorted(lengths) and all(sum(chosen) <= 64 for chosen, _ in plan)
        made = sum(times for _, times in plan)
        assert -(-sum(lengths) // 64) <= made <= bins(lengths, 64)


def test_lookups_equal_all_combinations():
    rng = random.Random(2)
    for _ in range(200):
        counts = np.array([0] + [rng.choice([0, 0, 1, 2]) for _ in range(12)])
        lengths = packing.Lengths(counts)
        for total in range(1, 13):
            pairs = [(a, total - a) for a in range(1, total) if all(counts[x] >= (a, total - a).count(x) for x in (a, total - a))]
            threes = [(a, b, total - a - b) for a in range(1, total) for b in range(1, total - a)]
            triples = [t for t in threes if all(counts[x] >= t.count(x) for x in t)]
            got = lengths.pair(total), lengths.triple(total)
            assert bool(got[0]) == bool(pairs) and bool(got[1]) == bool(triples)
            assert all(g is None or (sum(g) == total and lengths.has(g)) for g in got)


def packed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, __before int")
    return packing.pack(df, PATH, **how)


def test_pack(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([None, "", " ", *texts(120, 5), "the cat sat " * 100, *(["same text"] * 90)])] + [(None, "no id", "x", 1), (3, "id of another", "x", 1)]
    got = packed(spark, rows, size=64, what="ids").collect()
    assert got and got[0].asDict().keys() == {"doc_id", "text", "__before", "piece", "start", "length", "ids", "sequence_id", "offset"}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["text"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) <= 64
    assert len(by_doc) == len(rows)
    for (_, text), parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and all(r["start"] == 64 * r["piece"] for r in parts)
        assert [i for r in parts for i in r["ids"]] == [*reference(text), 1] and all(r["length"] == 64 for r in parts[:-1])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist() and sum(r["length"] for r in parts) <= 64
    lengths = [r["length"] for r in got]
    assert len(by_sequence) <= bins(lengths, 64)
    whole = packing.sequences(packed(spark, rows, size=64, what="ids")).collect()
    assert len(whole) == len(by_sequence) and sum(len(r["ids"]) for r in whole) == sum(lengths) and all(len(r["ids"]) <= 64 and r["starts"][0] == 0 for r in whole)
    sums = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed(spark, rows, size=64, what="ids_crc32").collect()}
    assert sums == {(r["doc_id"], r["piece"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}


def test_empty(spark):
    assert packed(spark, []).collect() == []
