import gzip
import hashlib

from lodestone.llm import warc

TRAP = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"
ROWS = [(i, f"http://h/{i}\r\nX: y", TRAP * (1 + i % 5) + "é" * (i % 7) + "p" * (i % 3)) for i in range(300)]
ROWS += [(1000, None, None), (1001, "", ""), (1002, "u", "x" * 99), (1003, "u", "x" * 99), (1004, "v" * 100_000, "y" * 100), (1005, "u", "y" * 100), (1004, "u", "y" * 100), (1006, "u", "\r\n\r\n" * 50_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS body", "3 AS first")
    warc.write(df, f"{tmp_path}/w", records_per_file=90)
    warc.write(df, f"{tmp_path}/joined", bytes_per_file=1 << 18, small=0)
    for name, span in (("w", 1 << 12), ("w", 1 << 20), ("joined", 1 << 20)):
        got = warc.records(spark, f"{tmp_path}/{name}", span).collect()
        first = {}
        for i, _, h in ROWS:
            first[h] = min(i, first.get(h, i))
        seen = sorted((r["id"], r["type"], r["stated"], r["refers_to"] or "") for r in got)
        want = []
        for i, _, h in ROWS:
            again = h is not None and len(h.encode()) >= 100 and first[h] != i
            want.append((f"<urn:lodestone:page:{i}>", "revisit" if again else "response", "sha256:" + hashlib.sha256((h or "").encode()).hexdigest(), f"<urn:lodestone:page:{first[h]}>" if again else ""))
        assert seen == sorted(want)
        assert all(r["type"] == "revisit" or "sha256:" + r["digest"] == r["stated"] for r in got)


def test_gzip_and_damage(spark, tmp_path):
    rec = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec) * 3)
    (tmp_path / "b.warc").write_bytes(rec + rec + b"broken" + rec)
    (tmp_path / "c.warc").write_bytes(b"x" + rec)
    (tmp_path / "d.warc").write_bytes(b"")
    got = sorted(r["path"].rpartition("/")[2] for r in warc.records(spark, str(tmp_path)).collect())
    assert got == ["a.warc.gz"] * 3 + ["b.warc"] * 2


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/w")
    assert warc.records(spark, f"{tmp_path}/w").count() == 0
