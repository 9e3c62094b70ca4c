import json

from askmill.operators import nested

TYPED = "row_id long, id string, question string, answer string, contexts array<struct<title:string,sentences:array<string>,passage_id:string>>, supporting_facts array<struct<title:string,sentence_index:int>>, question_type string, question_level string, payload string, tag int"


def found(tagged):
    return sorted(tuple(r) for r in nested.resolve_facts(nested.write_tagged(tagged)).collect())


def test_typed_records_with_nulls_everywhere_and_clashing_columns(spark):
    rows = [
        (1, "a", "q", None, [("T ", ["x", None, "y"], None), None, ("T", ["z"], "p"), (None, ["n"], None), ("U", None, None)], [("T", 2), ("T", 1), (" T", 0), ("T", 0), None, (None, 0), ("U", 0), ("T", None), ("T", -1)], None, None, "clash", 1),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "a", "q", "a", [], [], "t", "l", None, None),
    ]
    df = spark.createDataFrame(rows, TYPED)
    assert found(nested.visit_typed(df)) == [(1, 0, 0, 2), (1, 2, 0, 0), (1, 2, 2, 0), (1, 3, 0, 0), (1, 3, 2, 0)]
    sentences = nested.flat_table(nested.visit_typed(df), "sentence")
    assert {(r.pk, r.parent_pk, r.text) for r in sentences.collect() if r.parent_pk == "1/context/0"} == {("1/context/0/sentence/0", "1/context/0", "x"), ("1/context/0/sentence/1", "1/context/0", None), ("1/context/0/sentence/2", "1/context/0", "y")}
    assert nested.flat_table(nested.visit_typed(df), "record").count() == 3


def test_raw_records_of_mixed_shapes(spark):
    record = {"_id": "a", "context": ["T", ["T", ["x", 5, None, "y"]], {"title": "U\n", "sentences": ["z"]}, {"name": "n"}, ["only"], 7], "supporting_facts": [["T", "3"], ["T", 1], {"title": "U", "sentence_index": " 0 "}, ["T", 3.0], ["T", True], "T", None, ["T", "a1"], ["T", 0, 1]]}
    rows = [(1, json.dumps(record)), (1, json.dumps(record)), (2, None), (3, ""), (4, "{"), (5, "[1]"), (6, '{"context": {"a": 1}, "supporting_facts": "x"}'), (None, json.dumps(record))]
    df = spark.createDataFrame(rows, "row_id long, payload string")
    assert found(nested.visit_json(df.where("row_id <> 1 OR row_id IS NULL"))) == []
    assert found(nested.visit_json(df.limit(1))) == [(1, 0, 1, 3), (1, 2, 2, 0)]


def test_empty_tables_and_long_texts(spark):
    assert found(nested.visit_typed(spark.createDataFrame([], TYPED))) == []
    long = {"context": [["T", ["x" * 500_000]]], "supporting_facts": [["T", 0]]}
    assert found(nested.visit_json(spark.createDataFrame([(9, json.dumps(long))], "row_id long, payload string"))) == [(9, 0, 0, 0)]


def test_both_visitors_agree(spark):
    typed = spark.createDataFrame([(1, "a", "q", "b", [("T", ["x", None], "p")], [("T", 0)], "t", "l", None, None)], TYPED)
    raw = spark.createDataFrame([(1, json.dumps({"id": "a", "question": "q", "answer": "b", "question_type": "t", "level": "l", "context": [{"title": "T", "sentences": ["x", None], "passage_id": "p"}], "supporting_facts": [{"title": "T", "sentence_index": 0}]}))], "row_id long, payload string")
    for tag in nested.SCHEMAS:
        assert sorted(map(str, nested.flat_table(nested.visit_typed(typed), tag).collect())) == sorted(map(str, nested.flat_table(nested.visit_json(raw), tag).collect()))


def test_what_has_no_column_stays_in_rest(spark):
    record = {"_id": "a", "id": "b", "question": 5, "extra": {"x": [1]}, "context": [["T", ["x"]], {"name": "n"}, ["T", "no list"], {"title": 7, "sentences": ["y"], "url": "u"}], "supporting_facts": [["T", 0], ["T", 0, 9], {"title": "T", "sentence_index": 0, "why": "w"}, "T"]}
    df = spark.createDataFrame([(1, json.dumps(record))], "row_id long, payload string")
    t = nested.write_tagged(nested.visit_json(df))
    rest = lambda tag: [r.rest and json.loads(r.rest) for r in nested.flat_table(t, tag).orderBy("pos").collect()]
    assert rest("record") == [{"id": "b", "question": 5, "extra": {"x": [1]}}]
    assert rest("context") == [None, {"name": "n"}, {"sentences": "no list"}, {"title": 7, "url": "u"}]
    assert rest("fact") == [None, ["T", 0, 9], {"why": "w"}, "T"]
    assert {(r.parent_pk, r.title) for r in nested.flat_table(t, "link").collect()} == {("1/fact/0", "1/context/0/sentence/0"), ("1/fact/2", "1/context/0/sentence/0")}


def test_broken_surrogates(spark):
    df = spark.createDataFrame([(1, '{"_id": "\\ud800", "context": [["T\\ud800", ["\\udfff x"]]], "supporting_facts": [["T\\ud800", 0]]}')], "row_id long, payload string")
    assert found(nested.visit_json(df)) == [(1, 0, 0, 0)]
