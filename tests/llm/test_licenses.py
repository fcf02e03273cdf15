from gleanery.llm.licenses import TEMPLATES, license_matches, licenses

SCHEMA = "doc_id bigint, text string, line string, license string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_every_template_matches_itself_and_near_wordings(spark):
    rows = [(i, f"Some words.\n{text.upper()}\nmore") for i, text in enumerate(TEMPLATES.values())]
    found = {r.doc_id: r for r in licenses(frame(spark, rows)).collect()}
    assert [found[i].best_license for i in range(len(rows))] == list(TEMPLATES)
    assert all(r.best_dice == 1.0 and r.n_matches == 1 for r in found.values())


def test_dice_threshold_and_size_bounds(spark):
    templates = {"t": "a b c d e f g h i"}  # eight bigrams
    rows = [(1, "a b c d e f g x y"), (2, "a b c d e f x y z"), (3, "a b c d e"), (4, "a b c d"), (5, "A-b.C d,e;f\tg h i"), (6, "a b " * 50)]
    found = {(r.doc_id, r.line): r.dice for r in license_matches(frame(spark, rows), templates=templates, threshold=0.6).collect()}
    assert found == {(1, 1): 0.75, (2, 1): 0.625, (3, 1): 2 * 4 / 12, (5, 1): 1.0}


def test_rows_of_every_kind(spark):
    mit = TEMPLATES["mit"]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, mit), (4, mit), (None, mit), (5, f"{mit}\n{mit}\nAll rights reserved."), (6, "word " * 200_000)]
    found = sorted(((r.doc_id, r.n_matches, r.licenses, r.best_license) for r in licenses(frame(spark, rows)).collect()), key=repr)
    both = "all-rights-reserved,mit"
    assert found == sorted(
        [(1, 0, None, None), (2, 0, None, None), (3, 0, None, None), (4, 1, "mit", "mit"), (4, 1, "mit", "mit"), (None, 1, "mit", "mit"),
         (5, 3, both, "all-rights-reserved"), (6, 0, None, None)], key=repr,
    )
    assert licenses(frame(spark, rows).limit(0)).collect() == []
    assert licenses(frame(spark, rows), templates={}).filter("n_matches > 0").collect() == []


def test_ties_go_to_the_first_name_and_single_words_count(spark):
    found = licenses(frame(spark, [(1, "Same text"), (2, "WTFPL")]), templates={"b": "same text", "a": "same text", "w": "wtfpl"}).collect()
    assert {r.doc_id: r.best_license for r in found} == {1: "a", 2: "w"}


def test_no_python_in_the_plan(spark, capsys):
    licenses(frame(spark, [(1, "x")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
