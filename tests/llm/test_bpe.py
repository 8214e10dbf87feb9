import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import bpe

tok = bpe.load(bpe.tokenizer_path())


def reference(text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return np.asarray(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)


TEXTS = [None, "", " ", "Héllo  World's 123 !!á don't", "a b c\x1cd", "x<|endoftext|>y <|startoftext|>", "é ́a \n\r\t z", "'s't're 'LL I'VE", "日本語 テキスト ǅ İstanbul ΣΑΣ", "x" * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_words_give_what_the_library_gives(text):
    assert bpe.Encoder(bpe.tokenizer_path()).text(text) == reference(text)


BITS = ["the", "ing", "tion", "an", "er", "a", "Th", "qu", "zz", "é", "1", "!!", "'s", "in", " ", "\n", "e\u0301", "\u0301\u0323", "日本", "語", "ǅ", "İ", "ΑΣ", "\u1100\u1161\u11a8", "한국", "<|endoftext|>", "<|end", "''", "'ve", "👍🏽", "ﬁ", "\u00a0", "क्षि"]


def tree(text, whole_chars, width):
    return bpe.Encoder(bpe.tokenizer_path(), whole_chars=whole_chars, width=width).encoded([text])[0]


def whole(text):
    return tok.encode(text, add_special_tokens=False).ids


def test_tree_concatenation_is_exact():
    rng = random.Random(3)
    kinds = [BITS[:9], BITS[:14], BITS, BITS[14:], ["日本", "語", "漢", "字"], ["\u0301", "\u0323", "e", "\u0327"], ["\u1100", "\u1161", "\u11a8"], ["'", "s", "'re", "!"]]
    for n in range(80):
        text = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randint(300, 1500)))
        assert tree(text, 100, 8).ids.tolist() == whole(text), text
    for text in ("a" * 5000, "ab" * 4000, "1" * 3000, "!?" * 2000, "日本語" * 900, "e\u0301" * 1500):
        assert tree(text, 100, 8).ids.tolist() == whole(text)


def test_places_are_those_of_the_library():
    text = "".join(random.Random(8).choice(BITS) for _ in range(900))
    got, want = tree(text, 64, 8), tok.encode(text, add_special_tokens=False)
    assert [got.span(i) for i in range(len(got.ids))] == [want.token_to_chars(i) for i in range(len(want.ids))]


def test_pieces_of_different_tasks(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(2000)), "word " * 900, "日本語" * 700, "short", None, "x" * 1000, "x" * 1001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df, bpe.tokenizer_path(), whole_chars=128, task_chars=1000).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts + texts[:2]):
        assert got[i]["ids"] == whole(t or "") and got[i]["decoded"] == tok.decode(whole(t or ""), skip_special_tokens=False)


def test_cache_is_bounded():
    enc = bpe.Encoder(bpe.tokenizer_path(), cached=3)
    for n in range(20):
        text = f"one two{n} three{n % 3} four five one " + "x" * 100
        assert enc.text(text) == reference(text) and len(enc.known) + len(enc.old) <= 10


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, bpe.tokenizer_path(), what=("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, said = reference(r["text"])
        assert r["n_tokens"] == len(ids) // 4 and r["decoded"] == said and np.asarray(r["ids"], "<u4").tobytes() == ids
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.encode(df.limit(0), bpe.tokenizer_path()).count() == 0
