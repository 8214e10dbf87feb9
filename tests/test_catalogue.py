from lodestone.plans import catalogue


def test_route_documents_reads_whole_texts(spark, tmp_path):
    filler = "lorem ipsum " * 60
    rows = [(5, filler), (11, filler + "acil"), (17, filler + "ihale sözleşme satın alma")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["state_id"]: r for r in catalogue.route_documents(spark, str(tmp_path)).collect()}
    assert got[11]["channel"] != got[5]["channel"]
    assert got[17]["total"] != got[5]["total"]
