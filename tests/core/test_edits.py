from folioscope.operators import model


def test_edits_read_the_candidates_once(spark):
    rows = [(1, i, f"t{i}", i % 2 == 1, 1 if i % 2 else None, 0, 0, 1.0) for i in range(1, 6)] + [(2, 1, "u", True, 3, 0, 0, 1.0)]
    candidates = spark.createDataFrame(rows, "doc_id long, i int, text string, kept boolean, kept_level int, page_index int, y int, size double").mapInArrow(lambda b: b, "doc_id long, i int, text string, kept boolean, kept_level int, page_index int, y int, size double")
    reply = '{"retirer": [1, 2], "ajouter": [{"i": 4, "l": 5}, {"i": 4, "l": 9}, {"i": 3, "l": 1}], "niveaux": [{"i": 3, "l": 4}, {"i": 3, "l": 8}, {"i": 5, "l": 2}, {"i": 5, "l": 6}]}'
    replies = candidates.select("doc_id").distinct().filter("doc_id = 1").selectExpr("doc_id", f"'{reply}' as reply")
    out = model.edit_outline(candidates, replies)
    assert sorted((r.doc_id, r.i, r.level) for r in out.collect()) == [(1, 3, 4), (1, 4, 2), (1, 5, 6), (2, 1, 3)]
    # once for the candidates and once for the replies made of them here
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
