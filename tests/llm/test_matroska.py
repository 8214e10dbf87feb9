import hashlib
import random
import struct
import zlib

import pytest

from lodestone.llm import matroska as M

TEXTS = [None, "", "x", "é" * 96, "a" * 191, "a" * 192, "a" * 193, "long " * 200_000]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    payload, n = M.padded(text)
    assert n == len((text or "").encode()) and len(payload) % 192 == 0 and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ")
    stored = M.write(payload)
    media = M.parse(stored)
    assert media.doc_type == "matroska" and M.samples(stored, media, 1) == payload
    assert [p.timestamp_ns for p in media.packets] == [24_000_000 * i for i in range(len(payload) // 192)]
    assert [c[2] for c in media.cues] == media.clusters
    with pytest.raises(ValueError):
        M.parse(stored[:-1])


def test_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 77]
    xiph = bytes([3]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    ebml = bytes([3]) + M.vint(300) + b"".join((d + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") for d in (10 - 300, 255 - 10)) + b"".join(frames)
    head = M.element(M.EBML, M.element(0x4282, b"webm"))
    blocks = M._uint(M.TIMESTAMP, 7)
    blocks += M.element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", -2, 0x82) + xiph)
    blocks += M.element(M.BLOCK_GROUP, M.element(M.BLOCK, b"\x82" + struct.pack(">hB", 3, 0x06) + ebml))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + blocks
    file = head + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = M.parse(file)
    assert [(p.track, p.timestamp_ns // 10**6, p.lacing) for p in media.packets] == ([(1, 5, 1)] * 4 + [(2, 10, 3)] * 4) * 2
    assert [file[p.start : p.start + p.size] for p in media.packets] == frames * 4


def test_noise_never_breaks_the_parser():
    rng, good = random.Random(1), bytearray(M.write(M.padded("some text " * 100)[0]))
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            M.parse(bytes(bad))
        except ValueError:
            pass


def test_frames(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(2, "x", 0)], "doc_id long, text string, n_bytes int")
    for r in M.digest(df).collect():
        payload, n = M.padded(TEXTS[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    files = M.media_column(df)
    assert files.columns == ["doc_id", "text", "n_bytes", "media"]
    for r in M.packets(files).collect():
        assert r["error"] is None and sum(p["size"] for p in r["packets"]) == len(M.padded(TEXTS[r["doc_id"]])[0])
    bad = spark.createDataFrame([(1, None), (2, b"nonsense")], "id int, media binary")
    assert all(r["error"] and r["packets"] == [] for r in M.packets(bad).collect())
    assert M.digest(df.limit(0)).count() == 0 and M.packets(files.limit(0)).count() == 0


def test_clashing_names_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", "mine"), (1, "a", "mine"), (2, "long " * 200_000, None)], "doc_id long, text string, __text string")
    files = M.media_column(df).withColumnRenamed("__text", "__media")
    assert files.count() == 3
    got = {r["doc_id"]: r for r in M.packets(files).collect()}
    assert got[1]["__media"] == "mine" and sum(p["size"] for p in got[2]["packets"]) == len(M.padded("long " * 200_000)[0])
