import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import layout, routing, workflow
from lodestone.sources import chunker, corpus, office, sinks
from lodestone.sources.scratch import cut
from lodestone.streaming import sync

STATE = "state_id long, document_text string, summary string, intent string, requested_action string, topic string, subtopics array<string>, institution string, recipient string, entities array<string>, legal_references array<string>, previous_correspondence array<map<string,string>>, classification_topic string"


def states(spark, *rows):
    base = {"document_text": "", "summary": None, "intent": None, "requested_action": None, "topic": None, "subtopics": [], "institution": "Belediye", "recipient": None, "entities": [], "legal_references": [], "previous_correspondence": [], "classification_topic": None}
    return spark.createDataFrame([tuple(({"state_id": i} | base | r)[c.split()[0]] for c in STATE.split(", ")) for i, r in enumerate(rows)], STATE)


@pytest.fixture(scope="module")
def kb():
    return routing.KnowledgeBase(routing.DEPARTMENTS)


def test_routing(spark, kb):
    rows = [
        {"document_text": "Yıllık izin talebi için dilekçe. Personel izin istiyor.", "topic": "yıllık izin"},
        {"document_text": "Mahkeme kararı hakkında dava ve itiraz", "legal_references": ["2577 sayılı kanun"]},
        {"document_text": "Yol bozuk, çukur onarımı istiyorum", "subtopics": ["ağaç budama"]},
        {"document_text": ""},
        {"document_text": "park ağaç bahçe", "intent": "dava itiraz mahkeme hukuki görüş", "topic": "ağaç budama"},
    ]
    got = {(r["state_id"], r["label"]): r for r in routing.route(states(spark, *rows), kb).collect()}
    assert got[0, "primary"]["department"] == "İnsan Kaynakları" and got[1, "primary"]["department"] == "Hukuk Müşavirliği" and got[1, "primary"]["channel"] == "LEGAL"
    assert got[2, "primary"]["department"] == "Fen İşleri" and got[2, "secondary:ağaç budama"]["department"] == "Park ve Bahçeler"
    assert got[4, "primary"]["conflicts"] or got[4, "primary"]["department"] == "Hukuk Müşavirliği"
    assert all(0 <= r["total"] <= 1 for r in got.values())
    ok = {r["state_id"]: (r["success"], r["department"]) for r in routing.contract(routing.route(states(spark, *rows), kb)).collect()}
    assert ok[0] == (True, "İnsan Kaynakları") and len(ok) == 5


def test_model_scores_can_be_injected(spark, kb):
    got = routing.route(states(spark, {"document_text": "dava takibi istenir"}), kb, routing.heuristic).first()
    assert got["department"] == "Hukuk Müşavirliği" and got["signals"]["llm"] == 1.0


def test_engines_and_elements(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    read = lambda n: lambda df: df.where(f"page = {n}").withColumns({"text": F.lit(f"t{n}"), "confidence": F.lit(0.5)})
    got = {r["page"]: (r["engine"], r["text"]) for r in layout.first_of(pages, [("a", read(1)), ("b", read(2))], cut).collect()}
    assert got == {1: ("a", "t1"), 2: ("b", "t2"), 3: (None, "")}
    df = spark.createDataFrame([([("Seal", 0.9), ("text", 0.9), ("figure_title", 0.3)],)], "l array<struct<label:string,score:double>>")
    r = df.select(layout.kept_elements(F.col("l")).alias("k"), layout.visual_elements(F.col("l")).alias("v")).first()
    assert len(r["k"]) == 2 and [v["label"] for v in r["v"]] == ["Seal"]


def test_weights_are_shared_out(spark):
    w = states(spark, {}, {"entities": ["x"], "legal_references": ["y"]}).select("state_id", routing.weights().alias("w")).orderBy("state_id").collect()
    for r in w:
        assert sum(r["w"]) == pytest.approx(1)
    assert w[0]["w"]["rule"] == pytest.approx(0.20 + 0.25 / 5) and w[1]["w"]["rule"] == pytest.approx(0.20 + 0.05 / 7)


def test_workflow(spark):
    def result(status, rag=None):
        def stage(df):
            payload = F.lit(f'{{"requires_rag": {rag}}}') if rag else F.lit("{}")
            s = F.when(F.col("workflow_id") == 1, status).when((F.col("workflow_id") == 2) & (F.col("retries") == 0), "failed").otherwise("success")
            return df.select("workflow_id", s.alias("status"), payload.alias("payload"))

        return stage

    requests = spark.createDataFrame([(1,), (2,)], "workflow_id long")
    stages = {"ocr": result("success"), "validation": result("success", "false"), "rag": result("failed"), "summary": result("failed"), "writing": result("success")}
    state, history = workflow.run(requests, stages, cut)
    assert {r["workflow_id"]: r["outcome"] for r in state.collect()} == {1: "completed", 2: "completed"}
    seen = [(r["stage"], r["attempt"], r["status"]) for r in history.where("workflow_id = 1").orderBy("round").collect()]
    assert seen == [("ocr", 1, "success"), ("classification", 1, "skipped"), ("extraction", 1, "skipped"), ("validation", 1, "success"), ("summary", 1, "failed"), ("summary", 2, "failed"), ("routing", 1, "skipped"), ("writing", 1, "success")]
    assert workflow.collapsed(state).where("workflow_id = 1").first()["validation"] == '{"requires_rag": false}'
    state, _ = workflow.run(requests, {}, cut)
    assert {r["outcome"] for r in state.collect()} == {"terminated"}
    reg = workflow.Registry()
    reg.register("a")(lambda d: d)
    with pytest.raises(ValueError):
        reg.register("a")(lambda d: d)
    with pytest.raises(KeyError):
        reg.get("b")


def item(text, x0, y0, x1, y1):
    return {"text": text, "confidence": 0.9, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def test_layout(spark):
    raw = spark.createDataFrame([(1, ["a", " ", "c"], [0.9, 0.9, 0.001], [[[0.0, 0.0], [2.0, 0.0], [2.0, 1.0]]])], "page int, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>")
    assert [tuple(i) for i in layout.items(raw).first()["items"]] == [("a", 0.9, 0.0, 0.0, 2.0, 1.0)]
    js = spark.createDataFrame([('{"overall_ocr_res": {"rec_texts": ["x"], "scores": [0.5]}}',)], "j string").select(layout.parsed(F.col("j")).alias("p")).first()["p"]
    assert js["rec_texts"] == ["x"] and js["rec_scores"] == [0.5] and js["dt_polys"] is None
    two = [item(f"l{i}", 10, 20 * i, 180, 20 * i + 12) for i in range(1, 9)] + [item(f"r{i}", 320, 20 * i, 490, 20 * i + 12) for i in range(1, 9)] + [item("Title", 10, 0, 490, 12)]
    assert [i["text"] for b in layout.reading_order(two) for i in b] == ["Title", *[f"l{i}" for i in range(1, 9)], *[f"r{i}" for i in range(1, 9)]]
    assert layout.paragraphs([item("b", 60, 0, 90, 10), item("a", 0, 0, 50, 10), item("next", 0, 40, 50, 50), item("(1) x", 0, 52, 50, 62)]) and [t for t, _ in layout.paragraphs([item("b", 60, 0, 90, 10), item("a", 0, 0, 50, 10), item("next", 0, 40, 50, 50), item("(1) x", 0, 52, 50, 62)])] == ["a b", "next", "(1) x"]
    assert layout.paragraphs([]) == [] and layout.reading_order([]) == []
    each = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 12.0), (1, 60.0, 80.0), (1, 0.0, 100.0)], "page int, x0 double, x1 double")
    assert tuple(layout.column_gap(each).first()) == (1, 63.0, 38.5)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    its = spark.createDataFrame([(1, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1, (50.0, 50.0, 60.0, 60.0))], f"page int, item int, box {box}")
    lay = spark.createDataFrame([(1, 7, (4.0, 4.0, 9.0, 9.0)), (1, 8, (0.0, 0.0, 9.0, 9.0))], f"page int, block int, box {box}")
    assert sorted(((r["item"], r["block"]) for r in layout.blocks(its, lay).collect())) == [(0, 8), (1, None)]
    pages = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True)], "doc_id string, ok boolean")
    assert {r[0]: r[1] for r in layout.page_status(pages).collect()} == {"a": "partial", "b": "failed", "c": "complete"}
    assert layout.merged_text("baslik metin", "başlık metin") == "başlık metin" and layout.merged_text("abcdefghijklmnop qrst", "ijklmnop qrst uvwx") == "abcdefghijklmnop qrst uvwx" and layout.merged_text("", "x") == "x"


def test_pages_sidecars_manifest(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 2, "üç"), ("a.pdf", 1, "iki"), ("b.pdf", 0, "bir"), ("a.pdf", 3, "")], "source string, page int, text string")
    got = {r["source"]: r for r in corpus.merge_pages(pages).collect()}
    assert got["a.pdf"]["text"] == "[[RAG_PAGE:2]]\niki\n\n[[RAG_PAGE:3]]\nüç" and (got["a.pdf"]["page_start"], got["a.pdf"]["page_end"]) == (2, 4)
    for d in ("laws", "regulations"):
        (tmp_path / d).mkdir()
    (tmp_path / "laws/1_a.txt").write_text("metin")
    (tmp_path / "laws/README.md").write_text("no")
    (tmp_path / "laws/1_a.meta.json").write_text('{"law_name": "Ad", "tags": ["x", "y"], "law_number": "unknown"}')
    found = corpus.texts(corpus.files(spark, {"laws": f"{tmp_path}/laws", "regulations": f"{tmp_path}/regulations", "uploads": f"{tmp_path}/none"}))
    docs = corpus.with_sidecars(found.withColumn("law_name", F.lit("unknown")), corpus.sidecars(spark, f"{tmp_path}/laws")).collect()
    assert [(d["source_file"], d["source_type"], d["law_name"], d["tags"], d["law_number"], d["language"], d["text"]) for d in docs] == [("1_a.txt", "laws", "Ad", "x,y", "unknown", "tr", "metin")]
    m = lambda *r: spark.createDataFrame(list(r), "source_file string, sha256 string")
    assert sorted(map(tuple, corpus.manifest_diff(m(("a", "1"), ("b", "2"), ("d", "4")), m(("a", "1"), ("b", "x"), ("c", "3"))).collect())) == [("b", "changed"), ("c", "removed"), ("d", "changed")]
    assert corpus.manifest_diff(m(("a", "1")), m(("a", "1"))).count() == 0
    t = spark.createDataFrame([("[[RAG_PAGE:4]] a [[RAG_PAGE:5]] b",)], "t string")
    assert tuple(t.select(*(corpus.page_at(F.col("t"), F.lit(n)) for n in (3, 20, 99))).first()) == (None, 4, 5)


def test_labels_uploads_sets(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a.pdf", None, "form", True, ["x", "y"], "train", None)], "document_id string, pdf_path string, ocr_json_path string, label string, is_synthetic boolean, hard_case_tags array<string>, split string, notes string")
    corpus.write_label_manifest(rows, f"{tmp_path}/m")
    back = corpus.label_manifest(spark, f"{tmp_path}/m", ("form",)).first()
    assert back["is_synthetic"] is True and back["hard_case_tags"] == ["x", "y"]
    with pytest.raises(ValueError, match="form"):
        corpus.label_manifest(spark, f"{tmp_path}/m", ("rapor",))
    docs, unmapped = corpus.class_folders(spark.createDataFrame([("/d/Form/a_sentetik.pdf",), ("/d/X/b.pdf",)], "path string"), {"form": "form"})
    assert [(r["label"], r["is_synthetic"]) for r in docs.collect()] == [("form", True)] and unmapped.first()["folder"] == "X"
    assert sorted((r["stem"], r["ocr_json_path"]) for r in corpus.paired(spark.createDataFrame([("/a/x.pdf",), ("/a/y.pdf",)], "path string"), spark.createDataFrame([("/o/x.json",)], "path string")).collect()) == [("x", "/o/x.json"), ("y", None)]
    (tmp_path / "e.json").write_text('{"examples": [{"id": "1", "query": "q", "expected_law_numbers": ["5"]}]}')
    (tmp_path / "l.json").write_text('[{"id": "2", "query": "q2"}]')
    assert sorted((r["id"], r["split"], r["expected_law_numbers"]) for f in ("e", "l") for r in corpus.eval_set(spark, f"{tmp_path}/{f}.json").collect()) == [("1", "synthetic", ["5"]), ("2", "synthetic", [])]
    for n in range(6):
        b = base64.b64encode(b"x" * n).decode()
        assert spark.range(1).select(corpus.decoded_size(F.lit(b)).alias("n")).first()["n"] == n
    up = spark.createDataFrame([("a.pdf", "", 5), ("a.exe", None, 0), ("a", "image/png", 99 << 20)], "name string, mime string, size long").select(corpus.upload_errors(F.col("name"), F.col("mime"), F.col("size")).alias("e"))
    assert [r["e"] for r in up.collect()] == [[], ["unsupported_type", "empty_file"], ["file_too_large"]]
    kinds = corpus.dispatch(spark.createDataFrame([('{"query": "x"}',), ('{"pages": []}',), ('{"ocr": {}}',), ("{",), ("{}",)], "payload string")).collect()
    assert [(r["kind"], r["error"]) for r in kinds] == [("query", None), ("index", None), ("state", None), (None, "invalid_json"), (None, "unknown_request")]
    q = spark.createDataFrame([("soru  ne", "4857", "3"), ("soru", None, None)], "q string, l string, a string").select(corpus.contract_query(F.col("q"), F.col("l"), F.col("a")).alias("c"))
    assert [r["c"] for r in q.collect()] == ["4857 sayılı kanun madde 3 soru ne", "soru"]


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Bir</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_office(spark):
    df = spark.createDataFrame([("a.docx", docx()), ("b.docx", b"no zip"), ("c.xyz", b""), ("d.docx", None)], "source_file string, content binary")
    got = {r["source_file"]: (r["page"], r["text"], r["error"]) for r in office.pages(df).collect()}
    assert got["a.docx"] == (0, "Bir\na | b", None) and all(got[n][2] for n in ("b.docx", "c.xyz", "d.docx"))


def test_changes_leave_other_buckets_alone(spark, tmp_path):
    table = sinks.ChunkTable(spark, f"{tmp_path}/t", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, source_file string, text string")
    files = lambda: {p: p.read_bytes() for p in (tmp_path / "t").rglob("*.parquet") if "_current" not in str(p)}
    whole = lambda: sorted(tuple(r[c] for c in ("chunk_id", "source_file", "text")) for r in table.read().collect())
    first = [(f"{s}{i}", f"s{s}", "old") for s in range(20) for i in range(3)]
    table.upsert(rows(*first))
    before = files()
    live = {p.bucket: p.name for p in table._pointers()}
    assert table.upsert(rows(("30", "s3", "new"), ("30", "s3", "newer"), ("999", "s3", "more"))) == 2
    after = files()
    assert before.items() <= after.items() and len({p.parent for p in after.keys() - before.keys()}) == 1
    assert sum(live[p.bucket] != p.name for p in table._pointers()) == 1
    want = sorted([r for r in first if r[0] != "30"] + [("30", "s3", next(r[2] for r in whole() if r[0] == "30")), ("999", "s3", "more")])
    assert whole() == want
    table.upsert(rows(("50", "elsewhere", "moved")))  # a chunk that changes its source leaves the old bucket
    assert [r for r in whole() if r[0] == "50"] == [("50", "elsewhere", "moved")]
    assert table.delete(F.col("source_file") == "nowhere") == 3 and table.delete_sources(spark.createDataFrame([("s1",), ("s2",)], "source_file string")) == 4
    assert not [r for r in whole() if r[1] in ("s1", "s2")] and table.count() == 61 - 6
    table.delete(F.lit(True))
    assert table.count() == 0 and table.read().columns == ["chunk_id", "source_file", "text"]
    assert sinks.ChunkTable(spark, f"{tmp_path}/t", 3).buckets == 8 and table.upsert(rows(("1", "a", "x"))) == 6 and table.count() == 1


def test_table_and_stream(spark, tmp_path):
    table = sinks.ChunkTable(spark, f"{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, source_file string, text string")
    assert table.read() is None and table.count() == 0
    table.upsert(rows(("1", "a", "x"), ("2", "b", "y")))
    table.upsert(rows(("1", "a", "x2"), ("3", "c", "z")))
    assert {r["chunk_id"]: r["text"] for r in table.read().collect()} == {"1": "x2", "2": "y", "3": "z"} and table.version == 2
    assert table.delete(None) == 2 and table.delete(F.col("source_file") == "b") == 3 and table.count() == 2
    diff = sync.sweep(table, spark.createDataFrame([("a", "1")], "source_file string, sha256 string"), spark.createDataFrame([("a", "1"), ("c", "2")], "source_file string, sha256 string"))
    assert [tuple(r) for r in diff.collect()] == [("c", "removed")] and [r["chunk_id"] for r in table.read().collect()] == ["1"]
    assert table.reset() == 5 and table.count() == 0
    live = sinks.ChunkTable(spark, f"{tmp_path}/s")
    (tmp_path / "in").mkdir()
    text = "Madde 1 - " + "Gönderilen belge metni buradadır. " * 3
    doc = lambda n, day, t: f'{{"document_id": "{n}", "source_file": "{n}.txt", "text": "{t}", "submitted": "2024-01-0{day}T00:00:00Z"}}\n'
    (tmp_path / "in/1.json").write_text(doc("d1", 1, "eski " + text) + doc("d1", 2, text) + doc("d2", 1, text))
    run = lambda: sync.sync(sync.submissions(spark, f"{tmp_path}/in"), live, f"{tmp_path}/ck").awaitTermination(120)
    run()
    first = {r["document_id"]: r["text"] for r in live.read().collect()}
    assert set(first) == {"d1", "d2"} and not first["d1"].startswith("eski")
    (tmp_path / "in/2.json").write_text(doc("d1", 3, "Madde 2 - " + "yeni metin burada yer almaktadır. " * 3))
    run()
    assert {r["document_id"]: r["article_no"] for r in live.read().collect()} == {"d1": "2", "d2": "1"}
    chunks = chunker.split(spark.createDataFrame([("a.txt", text)], "source_file string, text string")).withColumn("chunk_id", F.lit(1).cast("long"))
    sinks.write_lexical_index(chunks, f"{tmp_path}/ix")
    assert spark.read.parquet(f"{tmp_path}/ix/postings").count() > 3
    report = sinks.ingestion_report(chunks.withColumns({"source_type": F.lit("laws"), "law_name": F.lit("")})).first()
    assert (report["chunks"], report["invalid"]) == (1, 1) and "| a.txt | 1 | 1 |" in sinks.markdown("R", {"x": sinks.ingestion_report(chunks.withColumns({"source_type": F.lit("laws"), "law_name": F.lit("")}))})
