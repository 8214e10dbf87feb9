import random

from lodestone.operators import dispatching, routing

STATE = "state_id long, document_text string, summary string, intent string, requested_action string, topic string, subtopics array<string>, institution string, recipient string, entities array<string>, legal_references array<string>, previous_correspondence array<map<string,string>>, writing_output string, classification_topic string"
SAID = [None, "", "izin talebi", "dava açma", "yol bozuk", "vergi borcu", "ağaç budama", "genel", "mahkeme kararı itiraz dava hukuki görüş", "personel maaş ve atama", "İzin", "park bahçe ağaç", "acil ödeme planı", "xyz"]


def states(n, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice(SAID)
    some = lambda values, most: None if rng.random() < 0.3 else [rng.choice(values) for _ in range(rng.randint(0, most))]
    out = []
    for i in range(n):
        out.append((i, " ".join(filter(None, [pick(), pick(), pick()])), pick(), pick(), pick(), pick(), some(SAID[2:], 4), rng.choice([None, "Belediye", "belediye ", "Valilik"]), rng.choice([None, "", "Fen", "hukuk müşavirliği"]),
                    some(["Personel", "gelir idaresi", "Ankara İdare Mahkemesi", "x"], 3), some(["657 sayılı kanun", "2577", "9999"], 3), some([{"department": "Mali"}, {"department": ""}], 2), rng.choice([None, "dava mahkeme itiraz"]), rng.choice([None, "", "yıllık izin", "icra", "özlük"])))
    return out


def as_rows(df):
    out = {}
    for r in df.collect():
        d = r.asDict(recursive=True)
        d["signals"] = {k: round(v, 9) for k, v in (d["signals"] or {}).items()}
        d["total"], d["confidence_score"] = round(d["total"], 9), round(d["confidence_score"], 9)
        out[d.pop("state_id"), d.pop("label")] = d
    return out


def test_a_table_of_departments_decides_as_the_expressions_do(spark):
    df = spark.createDataFrame(states(80, 3), STATE).repartition(3)
    kb = routing.KnowledgeBase(routing.DEPARTMENTS)
    table = dispatching.table(spark, routing.DEPARTMENTS)
    want = as_rows(routing.route(df, kb, routing.heuristic))
    got = as_rows(dispatching.route(df, table, dispatching.heuristic()))
    assert got.keys() == want.keys() and len(want) > 100
    for k, row in want.items():
        assert got[k] == row, k
    assert {d["status"] for d in want.values()} == {"CONFLICT_DETECTED", "AMBIGUOUS", "MULTI_ROUTE", "SINGLE_ROUTE"}


def test_many_departments(spark):
    """Thousands of departments: only candidates get the costly signals, and the right one is found."""
    many = [routing.Department(f"d{i}", "Belediye", f"Birim {i}", (f"konu{i}", f"iş{i} takibi"), (f"talep{i}",), (), (f"konu{i} talebi",)) for i in range(3000)]
    rows = [(i, f"bu belge konu{i * 70} hakkında iş{i * 70} takibi", None, None, None, None, None, "Belediye", None, None, None, None, None, None) for i in range(30)]
    got = dispatching.route(spark.createDataFrame(rows, STATE), dispatching.table(spark, many)).collect()
    assert {r["state_id"]: r["department"] for r in got} == {i: f"Birim {i * 70}" for i in range(30)}
