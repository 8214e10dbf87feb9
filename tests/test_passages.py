import random

import pytest

from lodestone.operators import passages

SPACE = " \t\n\x0b\f\r"


def brute(wanted, docs):
    out = set()
    for d, text in docs:
        at = [i for i, c in enumerate(text or "") if c not in SPACE]
        plain = "".join(text[i] for i in at)
        for p, words in wanted:
            want = "".join(c for c in words or "" if c not in SPACE)
            k = plain.find(want) if want else -1
            while k >= 0:
                out.add((p, d, at[k], at[k + len(want) - 1] + 1))
                k = plain.find(want, k + 1)
    return out


@pytest.mark.parametrize("sent, part", [(1 << 20, 1 << 18), (0, 40)])
def test_located_equals_find(spark, monkeypatch, sent, part):
    monkeypatch.setattr(passages, "SENT", sent)
    monkeypatch.setattr(passages, "PART", part)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé日") for _ in range(rng.randint(1, 9)))
    said = lambda n: rng.choice([" ", "\n", "  \t"]).join(word() for _ in range(n))
    wanted = [(i, said(rng.choice([1, 2, 5, 20]))) for i in range(25)] + [(30, "a"), (31, "ab"), (32, None), (33, " \n"), (34, "aaaa"), (35, "a" * 20)]
    docs = []
    for i in range(50):
        parts = [said(rng.randint(0, 30)) for _ in range(4)]
        for _ in range(3):
            parts.insert(rng.randint(0, 4), "".join(c + rng.choice(["", "", " ", "\n\n"]) for c in (rng.choice(wanted)[1] or "")))
        docs.append((i, rng.choice(["", " "]).join(parts)))
    docs += [(60, None), (61, ""), (62, "a" * 90), *((70 + i, wanted[3][1]) for i in range(30))]
    got = [tuple(r) for r in passages.located(spark.createDataFrame(wanted, "passage long, text string"), spark.createDataFrame(docs, "doc long, text string").repartition(5)).collect()]
    want = brute(wanted, docs)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
