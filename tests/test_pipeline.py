from pyspark.sql import functions as F

from askmill.config import Settings
from askmill.operators import generation as G
from askmill.operators.answers import CANNOT
from askmill.plans import pipeline
from askmill.sources import store
from askmill.sources.connectors import FakeClient

SF = "/root/testdata/sf0.001"


def small(spark):
    q = spark.createDataFrame([(1, "Which town has the old mill?", "Oslo"), (2, "Who built the mill?", "Ann")], "query_id long, question string, gold_answer string")
    c = spark.createDataFrame([(i, i * 10 + r, r, f"Mill {r}", ["The old mill stands in a town.", None], f"p{r}") for i in (1, 2) for r in range(3)], "query_id long, id long, rank int, title string, sentences array<string>, passage_id string")
    return q, c


def test_predictions(spark):
    rows = {r.question_id: r for r in pipeline.predict(*small(spark), FakeClient).collect()}
    assert set(rows) == {1, 2} and rows[1].answer == "Mill 0"
    assert [tuple(f) for f in rows[1].sp] == [("Mill 0", 0)] and rows[1].decision.supporting_passage_ids == ["p0"]
    assert rows[1].gold_answer == "Oslo" and 0 <= rows[1].decision.confidence <= 1


def test_specialist_without_checks(spark):
    s = Settings()
    s.generator.specialist_mode, s.verifier.enabled = True, False
    rows = pipeline.predict(*small(spark), FakeClient, s, use_model_scorer=True).collect()
    assert len(rows) == 2 and rows[0].full_response.startswith("[SP: ") and rows[0].verification.support_score is None


def test_checks_by_a_model(spark):
    s = Settings()
    s.verifier.mode = "nli"
    rows = {r.question_id: r for r in pipeline.predict(*small(spark), FakeClient, s).collect()}
    assert set(rows) == {1, 2} and rows[1].verification.support_score is not None


def test_unsupported_answers_are_asked_again_with_feedback(spark):
    class Learning(FakeClient):
        def complete(self, prompts, model, temperature):
            return ['{"supporting_fact_numbers": [0], "answer": "%s"}' % ("The old mill stands in a town" if G.FEEDBACK in p else "Zeta") for p in prompts]

    s = Settings()
    rows = pipeline.predict(*small(spark), Learning, s).collect()
    assert {r.answer for r in rows} == {"The old mill stands in a town"} and all(r.verification.is_supported for r in rows)
    s.verifier.retry_on_failure = False
    assert {r.answer for r in pipeline.predict(*small(spark), Learning, s).collect()} == {"Zeta"}


def test_failed_and_empty_questions(spark):
    class Down(FakeClient):
        def complete(self, prompts, model, temperature):
            raise OSError("down")

    q, c = small(spark)
    for make in (Down, FakeClient):
        rows = {r.question_id: r for r in pipeline.predict(q, c.where("query_id = 1"), make).collect()}
        assert set(rows) == {1, 2} and rows[2].answer == CANNOT and rows[2].sp == [] and rows[2].verification is None
        assert (rows[1].answer == CANNOT) == (make is Down)


def test_limits_ids_and_model_entities(spark):
    class Listing(FakeClient):
        def complete(self, prompts, model, temperature):
            return ['["Halmond"]' if p.endswith("nothing else.") and "named entities" in p else x for p, x in zip(prompts, super().complete(prompts, model, temperature))]

    every = pipeline.questions_of(spark, SF).orderBy("query_id").collect()
    ids = spark.read.parquet(f"{SF}/examples.parquet").where(F.col("row_id") == every[1].query_id).select("id")
    got = pipeline.run(spark, SF, Listing, limit=3, ids=ids, model_entities=True).collect()
    assert [r.question_id for r in got] == [every[1].query_id]


def test_a_run_resumes(spark, tmp_path):
    to = str(tmp_path / "saved")
    index = str(tmp_path / "index")
    pipeline.run(spark, SF, save_to=to, index=index)
    n = spark.read.parquet(to).count()
    assert store.load_index(spark, index, "none") is None and store.load_index(spark, index, "passages")[0].count() > 0
    pipeline.run(spark, SF, save_to=to, index=index)
    assert spark.read.parquet(to).count() == n > 0
