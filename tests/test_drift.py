import json

from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askmill.operators import drift
from askmill.plans import dealt

SCHEMA = "row_id long, run_name string, file_no int, file_name string, question_id string, payload string, answer int"


def rows(*files):
    return [(i, "r", n, f"f{n}", q, p if p is None or isinstance(p, str) else json.dumps(p), 1) for n, f in enumerate(files, 1) for i, (q, p) in enumerate(f)]


def test_changes(spark):
    one = [("a", {"answer": "x", "sp": [["t", 0]], "v": {"s": 1, "old": 2}, "n": None}), ("b", {"answer": "y", "sp": []}), ("c", None), ("d", ""), ("e", '{"cut')]
    two = [("a", {"text": "X.", "sp": [["t", "0"]], "v": {"s": 1, "new": "z"}, "n": 4}), ("b", {"text": "y", "sp": []})]
    four = [("a", {"text": {"v": "p"}, "w": {"s": 2, "new": "q"}})]
    three = [("a", {"text": "p", "w": {"s": 2, "new": "q"}})]
    got = {tuple(r) for r in drift.changes(drift.ingest(spark.createDataFrame(rows(one, two, three, four), SCHEMA))).collect()}
    assert got == {("f2", "renamed", "answer", "text"), ("f2", "type_changed", "sp", ""), ("f2", "removed", "v.old", ""), ("f2", "added", "v.new", ""), ("f3", "removed", "sp", ""), ("f3", "removed", "n", ""), ("f3", "renamed", "v", "w"), ("f4", "type_changed", "text", "")}


def test_uniform_table_keeps_everything_and_replays(spark):
    df = spark.createDataFrame(rows([("a", {"answer": 5, "gold": "g", "sp": [["t", "1"], {"title": "u", "sentence_index": 2}], "x": {"y": [1]}}), ("b", {"answer": "k", "sp": [["t", 1]], "a.b": None}), ("c", "nope")]), SCHEMA)
    t = drift.ingest(df)
    a, b, c = sorted(t.collect(), key=lambda r: r.question_id)
    assert (a.answer, a.gold_answer, a.sp) == (None, None, None) and a.src_answer == 1
    assert {k: json.loads(v) for k, v in a._rescued.items()} == {"answer": 5, "gold": "g", "sp": [["t", "1"], {"title": "u", "sentence_index": 2}], "x": {"y": [1]}}
    assert b.answer == "k" and [tuple(x) for x in b.sp] == [("t", 1)] and b._rescued == {"a.b": "null"}
    assert not c._readable and not c._rescued and c._corrupt == "nope"
    a = next(r for r in drift.replay(t, {"gold": "gold_answer"}).collect() if r.question_id == "a")
    assert a.gold_answer == "g" and "gold" not in a._rescued and "x" in a._rescued and a._replayed == {"gold_answer": "gold"}
    assert a.answer == "5" and [tuple(x) for x in a.sp] == [("t", 1), ("u", 2)] and {"answer", "sp"} <= set(a._rescued)


def test_inner_values_are_kept(spark):
    records = [
        {"verification": {"support_score": "high", "note": "keepme", "is_supported": True}},
        {"sp": [["T", 1, "extra"]]},
        {"sp": [{"title": "T", "sentence_index": 2, "why": "w"}]},
        {"decision": {"confidence": 0.5, "new_inner": None}, "decision.new_inner": 3},
        {"verifier": {"support_score": 1, "evidence_count": 2.5}, "verification": None},
        {"verification": {}, "answer": "half \ud800 a pair", "gold": ["one"], "\ud801": 1},
    ]
    df = spark.createDataFrame(rows([(str(i), r) for i, r in enumerate(records)]), SCHEMA).drop("answer")
    first = sorted(drift.ingest(df).collect(), key=lambda r: r.row_id)
    again = sorted(drift.replay(drift.ingest(df), {"gold": "gold_answer", "verifier": "verification"}).collect(), key=lambda r: r.row_id)
    for rows_ in (first, again):
        for r, want in zip(rows_[:5], records):
            assert drift.rebuild(r.asDict()) == want
        last = drift.rebuild(rows_[5].asDict())
        assert last["answer"] == records[5]["answer"] and last["gold"] == ["one"] and last["verification"] == {} and last["\\ud801"] == 1
    assert first[0].verification.is_supported and json.loads(first[0]._rescued["verification"]) == {"support_score": "high", "note": "keepme"}
    assert again[4].verification.support_score == 1 and json.loads(again[4]._rescued["verifier"]) == {"evidence_count": 2.5}
    assert again[5].gold_answer == "one"


_JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)
_FACT = st.tuples(st.text(max_size=3), st.integers(-3, 2**33)).map(list) | st.fixed_dictionaries({"title": st.text(max_size=3), "sentence_index": st.integers(0, 9) | st.just("4")}) | _JSON
_NAME = st.sampled_from(["a.b", "verification.x", "gold", "verifier", "cited", ""])
_INNER = st.dictionaries(st.sampled_from(["support_score", "is_supported", "evidence_count", "confidence", "note", "a.b"]), st.booleans() | st.integers(-5, 2**40) | st.floats(allow_nan=False, allow_infinity=False) | st.just("0.5") | _JSON, max_size=4)
_RECORD = st.dictionaries(_NAME, _JSON | _INNER, max_size=3).flatmap(lambda a: st.fixed_dictionaries({}, optional={"answer": _JSON, "gold_answer": st.text(max_size=4) | st.lists(st.text(max_size=3), max_size=2), "sp": st.lists(_FACT, max_size=3) | _JSON, "verification": _INNER | _JSON, "decision": _INNER | _JSON}).map(lambda b: a | b))


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(_RECORD)
def test_typed_columns_and_rescue_rebuild_any_record(record):
    typed, rescued, _ = drift.visit(json.dumps(record))
    row = {t: typed.get(t) for t in drift.TARGET} | {"_rescued": rescued}
    assert drift.rebuild(row) == record
    rest = dict(rescued)
    values = {t: typed.get(t) for t in drift.TARGET}
    moved = drift._fill(values, rest, {t: {"gold_answer": ["gold"], "verification": ["verifier"], "sp": ["cited"]}.get(t, []) for t in drift.TARGET})
    assert drift.rebuild(values | {"_rescued": rest, "_replayed": moved}) == record


def test_empty_table(spark):
    assert drift.changes(drift.ingest(spark.createDataFrame([], SCHEMA))).count() == 0


def test_kinds():
    assert drift.kinds([["a", 1], [None, ""]]) == {"array", "[array", "[[string", "[[number"}
    assert drift.kinds([]) == drift.kinds("") == drift.kinds(None) == set()


def test_detected_renames_are_promoted(spark):
    files = [[(q, {"answer": f"{q}1", "sp": [[q, 0]], "n": 3}) for q in "abc"], [(q, {"reply": f"{q}1", "sp": [[q, 0]]}) for q in "abc"], [(q, {"out": f"{q}1", "sp": [[q, 0]], "other": "z"}) for q in "abc"]]
    df = spark.createDataFrame(rows(*files), SCHEMA).drop("answer")
    t = drift.ingest(df)
    other = df.where("file_no = 3").withColumn("run_name", F.lit("s"))  # no rename in this run
    got = drift.replay(drift.ingest(df.unionByName(other)), {}, drift.promotions(t)).collect()
    assert all(r.answer == f"{r.question_id}1" and set(r._rescued) <= {"n", "other"} and r._replayed in ({}, {"answer": "reply"}, {"answer": "out"}) for r in got if r.run_name == "r") and sum(r.run_name == "r" for r in got) == 9
    assert all(r.answer is None and "out" in r._rescued for r in got if r.run_name == "s")


def test_promoted_names():
    assert drift.promoted_names([("answer", "gold_answer"), ("gold_answer", "x"), ("x", "y"), ("q", "question"), ("u", "w")]) == {"x": "gold_answer", "q": "question", "y": "gold_answer"}


def test_no_castable_value_leaves_its_column_empty(spark):
    t = dealt.uniform(spark, SF).collect()
    for r in t:
        for name, v in (r._rescued or {}).items():
            column = dealt.ALIASES.get(name, name)
            assert column not in drift.TARGET or r[column] is not None or drift.cast(column, json.loads(v)) is None, (r.row_id, name, v)
    assert sum(r._readable for r in t) > 50 and all(r.sp is not None for r in t if r._readable and set(r._rescued) >= {"sp"})


def test_replayed_rows_rebuild_the_stored_records(spark):
    payloads = {r.row_id: r.payload for r in spark.read.parquet(f"{SF}/raw_predictions.parquet").collect()}
    for r in dealt.uniform(spark, SF).collect():
        assert drift.rebuild(r.asDict()) == json.loads(payloads[r.row_id]) if r._readable else r._corrupt == payloads[r.row_id]
