import math

import pytest
from pyspark.sql import functions as F

from askmill.functions import scores as S
from askmill.functions import text as X
from askmill.operators.answers import parse_response


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "official", "custom"), [("U.S.A.", "usa", "us"), ("The  Crown, an A!", "crown", "crown"), ("", "", ""), (None, None, None)])
def test_normalize(spark, text, official, custom):
    t = F.lit(text).cast("string")
    assert one(spark, X.normalize_official(t)) == official
    assert one(spark, X.normalize_custom(t)) == custom


def test_answer_scores(spark):
    score = lambda p, g: tuple(round(x, 6) for x in one(spark, S.answer_score(F.lit(p), F.lit(g))))
    assert score("yes", "no") == (0, 0, 0, 0)
    assert score("the big big cat", "big cat") == (0, 0.8, round(2 / 3, 6), 1)
    assert score("", "") == (1, 0, 0, 0)


def test_fact_scores(spark):
    facts = lambda *x: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in x)) if x else F.array().cast("array<struct<t:string,i:string>>")
    assert one(spark, S.fact_score(facts(), facts()))["em"] == 1
    assert one(spark, S.fact_score(facts(("T", "0"), ("T", "0")), facts(("T", "0"), ("U", "1"))))["f1"] == pytest.approx(2 / 3)


def test_confidence_and_fusion(spark):
    n = F.lit(None).cast("double")
    assert one(spark, S.confidence(F.lit(0.5), n)) == 0
    assert one(spark, S.confidence(F.lit(0.04), F.lit(0.03))) == pytest.approx(0.25)
    assert one(spark, S.rrf(F.lit(0))) == pytest.approx(1 / 21)
    assert one(spark, S.decision_confidence(F.lit(0.8), F.lit(False), F.lit(0.0))) == pytest.approx(0.355)
    assert one(spark, S.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]


@pytest.mark.parametrize(("text", "want"), [("Are both from England?", True), ("Which is older?", False), (" is it", True), ("Isle?", False)])
def test_yesno(spark, text, want):
    assert one(spark, X.is_yesno_question(F.lit(text))) is want


def test_claims(spark):
    assert one(spark, X.claims(F.lit("A b. C d! E"))) == ["A b.", "C d!", "E"]
    assert one(spark, X.claims(F.lit(" "))) == []


@pytest.mark.parametrize(("text", "want"), [("It is the Chief of Protocol.", "Chief of Protocol"), ("The answer is: the Crown.", "Crown"), ('"Yes."', "yes"), ("3,677 seated (4,000 capacity)", "3,677 seated"), ("", ""), ("one two three four five six.", "one two three four five six.")])
def test_generated(spark, text, want):
    assert one(spark, X.normalize_generated(F.lit(text))) == want


def test_numeric(spark):
    get = lambda a, q, e: one(spark, X.numeric_answer(F.lit(a), F.lit(q), F.lit(e)))
    assert get("many", "How many people?", "In 1900 it had 3,677 seats.") == "3,677"
    assert get("many", "How many?", "200 and 317 of them") == "317"
    assert get("many", "Who?", "317") == "many"


def test_bridge_entities(spark):
    got = one(spark, X.bridge_entities(F.lit("Kiss"), F.array(F.lit("Shirley Temple met NASA in Paris (1928). Rome fell.")), F.lit("Who is shirley temple?"), 9))
    assert got == ["Kiss", "NASA", "Paris", "Rome", "1928"]


def mapping():
    return F.create_map(F.lit(0), F.struct(F.lit("T").alias("title"), F.lit(4).alias("idx")), F.lit(1), F.struct(F.lit("U").alias("title"), F.lit(2).alias("idx")))


@pytest.mark.parametrize(
    ("text", "answer", "facts", "stage"),
    [
        ('{"answer": "The Crown.", "supporting_fact_numbers": [0, 9]}', "The Crown.", [("T", 4)], 1),
        ('```json\n{"supporting_fact_numbers": ["1"], "answer": "x"}\n```', "x", [("U", 2)], 1),
        ('{"answer": "a", "supporting_facts": [["P", 3]]}', "a", [("P", 3)], 1),
        ('{"answer": "a b", "supporting_fact_numbers": [0, 1],, }', "a b", [("T", 4), ("U", 2)], 2),
        ("The answer is: the Crown. See Fact 1 and fact 0.", "Crown", [("T", 4), ("U", 2)], 3),
        ("Supporting facts: [Some Title, 3]\nAnswer: It is Rome", "Rome", [("Some Title", 3)], 3),
        ('{"answer": "cannot tell"}', "cannot tell", [], 1),
        (None, "", [], 3),
        ("", "", [], 3),
    ],
)
def test_parse(spark, text, answer, facts, stage):
    r = one(spark, parse_response(F.lit(text).cast("string"), mapping()))
    assert (r["answer"], [tuple(f) for f in r["facts"]], r["stage"]) == (answer, facts, stage)


def test_match_sentence(spark):
    s = F.array(F.lit("a"), F.lit(None), F.lit(" b c "))
    assert one(spark, X.match_sentence(s, F.lit("b c"))) == 2
    assert one(spark, X.match_sentence(s, F.lit("zz"))) is None
    assert math.isclose(one(spark, S.sigmoid(F.lit(0.0))), 0.5)
