import json

import pytest
from pyspark.sql import functions as F

from askmill import config
from askmill.operators import answers as A
from askmill.operators import evidence as E
from askmill.operators import generation as G
from askmill.operators import scoring
from askmill.sources import store
from askmill.sources.connectors import FakeClient, HttpClient, best_span, embedder, model_scorer, probe


@pytest.fixture(scope="module")
def chosen(spark):
    rows = [("q", i, "Which town has the old mill?", f"Mill {i}", [f"The old mill {i} stands in a town.", " ", None, "Nothing here."], i) for i in range(7)]
    r = E.rerank(spark.createDataFrame(rows, "query_id string, id long, question string, title string, sentences array<string>, retrieval_rank int"))
    return r, E.select_sentences(r)


def test_rerank_and_select(chosen):
    r, s = chosen
    assert [x.id for x in r.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert sorted((x.rank, x.idx) for x in s.collect()) == [(0, 0), (0, 3), (1, 0), (1, 3), (2, 0), (2, 3)]


@pytest.mark.parametrize(("rank", "scores", "kept"), [(0, [0.9, 0.3, 0.2], 2), (2, [0.3, 0.2], 1), (0, [0.9] * 8, 5)])
def test_sentence_rule(spark, rank, scores, kept):
    import math

    texts = [f"{math.log(s / (1 - s))}" for s in scores]
    df = spark.createDataFrame([("q", 1, "q", "t", texts, rank)], "query_id string, id long, question string, title string, sentences array<string>, rank int")
    assert E.select_sentences(df, lambda q, t: t.cast("double")).count() == kept


def test_prompt(chosen):
    r, s = chosen
    p = E.prompts(r, s).first()
    assert p.prompt.startswith("Evidence:\nPassage 0: [Mill 0]\n  [0] The old mill 0") and "\nPassage 4: [Mill 4]\n" in p.prompt
    assert "Fact 5: [Mill 2, 3] Nothing here." in p.prompt and tuple(p.mapping[5]) == ("Mill 2", 3)
    assert E.prompts(r, s, most=20).first().prompt.endswith("\n[... truncated ...]")
    assert p.route == "complex"


def test_generate_repair_and_specialist(chosen):
    p = E.prompts(*chosen)
    g = G.generate(p, FakeClient).first()
    assert g.answer == "Mill 0" and [tuple(f) for f in g.facts] == [("Mill 0", 0)]
    s = G.generate_specialist(p, FakeClient).first()
    assert s.answer == "Mill 0" and s.response.startswith("[SP: {")


def clients():
    """Made inside a function, so that they travel by value."""

    class Stubborn(FakeClient):
        """Answers without facts at first; says what it was asked."""

        def complete(self, prompts, model, temperature):
            return [f'{{"supporting_fact_numbers": [0], "answer": "by {model}"}}' if p.startswith("Give the answer") else '{"answer": "Mill"}' for p in prompts]

    class Failing(FakeClient):
        def complete(self, prompts, model, temperature):
            if any("Mill 0" in p for p in prompts):
                raise OSError("no server")
            return super().complete(prompts, model, temperature)

        entail = spans = None

    return Stubborn, Failing


Stubborn, Failing = clients()


def test_repair_asks_the_routed_model(chosen):
    p = E.prompts(*chosen)
    assert G.generate(p, Stubborn, "s", "l").first().answer == "by l"
    r = G.generate(p.withColumn("route", F.lit("simple")), Stubborn, "s", "l").first()
    assert r.answer == "by s" and [tuple(f) for f in r.facts] == [("Mill 0", 0)]
    assert G.generate(p, Stubborn, repair=False).first().answer == "Mill"
    assert [tuple(f) for f in G.generate_specialist(p, Stubborn).first().facts] == [("Mill 0", 0)]


def test_a_failed_call_fails_one_prompt(spark, chosen):
    p = E.prompts(*chosen)
    other = p.withColumn("query_id", F.lit("other")).withColumn("prompt", F.lit("Fact 0: [Town, 0] x"))
    got = {r.query_id: r for r in G.generate(p.unionByName(other), Failing).collect()}
    assert got["q"].answer == A.CANNOT and got["q"].facts == [] and got["q"].response is None
    assert got["other"].answer == "Town"
    assert G.generate_specialist(p, Failing).first().answer == A.CANNOT


def test_feedback_and_plain_generation(chosen):
    p = E.prompts(*chosen)
    assert G.with_feedback(p.withColumn("a", F.lit("Oslo")), "a").first().prompt.startswith(G.FEEDBACK + ' Answer given before: "Oslo".\n\nEvidence:')
    assert G.with_feedback(p).first().prompt.startswith(G.FEEDBACK + "\n\nEvidence:")
    assert G.generate_with_prompt(p, FakeClient, "m").first().answer == "Mill 0"


def test_model_checks(spark):
    df = spark.createDataFrame([(1, "Rome wins. Zeta loses.", ["T::0", "T::1"], ["Rome wins today", " "], ["T::0"]), (2, "yes", ["T::0"], ["x"], []), (3, "", [], [], []), (4, "Rome", None, None, None)], "i int, answer string, ids array<string>, texts array<string>, cited array<string>")
    plain = {r.i: r for r in A.verify(df, "answer", "ids", "texts", "cited").collect()}
    for mode in ("nli", "qa"):
        got = {r.i: r for r in G.verified(df, "i", FakeClient, mode, "answer", "ids", "texts", "cited").collect()}
        assert len(got) == 4 and got[2].support_score == plain[2].support_score and got[3].support_score == got[4].support_score == 0
        assert got[1].claims == 2 and got[1].unsupported == ["Zeta loses."]
        # a client without such a model leaves the overlap
        got = {r.i: r for r in G.verified(df, "i", Failing, mode, "answer", "ids", "texts", "cited").collect()}
        assert got[1].support_score == plain[1].support_score


def test_entailment_takes_off_contradictions(spark):
    class Judge(FakeClient):
        def entail(self, pairs):
            return [(0.8, 0.4), (0.1, 0.9)]

        def spans(self, pairs):
            return [(0.1, "x"), (0.9, "")]

    df = spark.createDataFrame([("a", "b", 0.5), ("c", "d", 0.2)], "claim string, text string, overlap double").coalesce(1)
    assert [r.support for r in G.model_support(df, Judge).collect()] == pytest.approx([0.35 * 0.5 + 0.65 * 0.6, 0.35 * 0.2])
    assert [r.support for r in G.model_support(df, Judge, "qa").collect()] == pytest.approx([0.45 * 0.5 + 0.55 * 0.05, 0.45 * 0.2])


def test_best_span():
    import numpy as np

    assert best_span(np.array([0.0, 50.0, 0.0]), np.array([50.0, 0.0, 0.0])) == (pytest.approx(0, abs=1e-6), 1, 1)
    score, first, last = best_span(np.eye(40)[3] * 60, np.eye(40)[39] * 60)
    assert (first, last) == (3, 19) and best_span(np.eye(4)[1] * 60, np.eye(4)[2] * 60) == (pytest.approx(1.0), 1, 2)


def test_evidence_forms(spark):
    want = (["T::0", "T::1"], ["x", "y"])
    forms = {"array<struct<title:string,sentences:array<string>>>": [("T", ["x", "y"])], "array<struct<title:string,idx:int,text:string>>": [("T", 0, "x"), ("T", 1, "y")], "map<string,string>": {"T::0": "x", "T::1": "y"}}
    for kind, v in forms.items():
        r = A.evidence_items(spark.createDataFrame([(v,)], f"e {kind}"), "e").first()
        assert (r.ids, r.texts) == want
    r = A.evidence_items(spark.createDataFrame([(["x", "y"],)], "e array<string>"), "e").first()
    assert (r.ids, r.texts) == (["evidence::0", "evidence::1"], ["x", "y"])


def test_yesno_prompt_and_metadata(chosen):
    r, s = chosen
    p = E.prompts(r.withColumn("question", F.lit("Is the mill old?")), s).first()
    assert '"yes" or "no"' in p.prompt
    m = E.prompt_facts(E.prompts(r, s), r, s).first()
    assert (m.passages, m.sentences) == (5, 6) and m.letters > 100
    assert {k: [tuple(f) for f in v] for k, v in E.passage_facts(s).first().mapping.items()}[1] == [("Mill 1", 0), ("Mill 1", 3)]


def test_the_http_client_against_a_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            known = {"/api/generate": {"response": f"<think>hm</think> {body.get('prompt')}!"}, "/api/embed": {"embeddings": [[3.0, 4.0]] * len(body.get("input", []))}}
            if body.get("model") == "chatty":
                known["/api/chat"] = {"message": {"content": body["messages"][0]["content"] + "?"}}
            self.send_response(200 if self.path in known else 404)
            self.end_headers()
            self.wfile.write(json.dumps(known.get(self.path, {})).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = HttpClient(f"http://127.0.0.1:{server.server_port}/", "e", timeout=5)
        assert c.complete(["a"], "chatty", 0.1) == ["a?"] and c.complete(["a", "b"], "plain", 0.1) == ["a!", "b!"]
        assert c.embed(["x", "y"]) == [pytest.approx([0.6, 0.8])] * 2
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        HttpClient("http://127.0.0.1:9").complete(["a"], "m", 0)


def test_entities(spark):
    df = spark.createDataFrame([("q", "Who knew Rome?", 0, "Rome", ["Anna Bell met Rome."])], "query_id string, question string, rank int, title string, sentences array<string>")

    class Listing(FakeClient):
        def complete(self, prompts, model, temperature):
            return ['Here: ["Anna Bell", "anna bell", "Rome", "Oslo"]'] * len(prompts)

    assert [r.entity for r in G.extract_entities(df, Listing).orderBy("pos").collect()] == ["Anna Bell", "Oslo"]
    assert [r.entity for r in G.extract_entities(df, None).orderBy("pos").collect()] == ["Rome", "Anna Bell", "Bell"]


def test_models(spark):
    df = spark.createDataFrame([("a b", "a c", 0.5), (None, "x", 0.2)], "claim string, text string, overlap double")
    assert df.select(model_scorer(FakeClient)(F.col("claim"), F.col("text")).alias("s")).first().s == 0.5
    assert G.model_support(df, FakeClient).first().support == pytest.approx(0.35 * 0.5 + 0.65 * 0.5)
    assert G.model_support(df, FakeClient, "qa").first().support == pytest.approx(0.45 * 0.5 + 0.55 * (0.7 * 0.5 + 0.3 * 0))  # the span is the stopword a
    assert len(df.select(embedder(FakeClient)(F.col("text")).alias("v")).first().v) == probe(FakeClient) == 16


def test_verify_edges(spark):
    df = spark.createDataFrame([(1, "", ["T::0"], ["x"], []), (2, "a b", [], [], []), (3, None, None, None, None), (4, "Rome wins. Zeta loses.", ["T::0"], ["Rome wins today"], ["T::0", "U::1"])], "i int, answer string, ids array<string>, texts array<string>, cited array<string>")
    rows = {r.i: r for r in A.verify(df, "answer", "ids", "texts", "cited").collect()}
    assert all(rows[i].support_score == 0 and not rows[i].is_supported for i in (1, 2, 3))
    assert rows[4].claims == 2 and rows[4].unsupported == ["Zeta loses."] and rows[4].coverage == 0.5


def test_abstain(spark):
    d = spark.range(1).select(A.decide(F.lit("x"), F.lit(0.8), F.lit(False), F.lit(0.0), abstain=True).alias("d")).first().d
    assert d.answer == "Insufficient evidence" and d.confidence == pytest.approx(0.71)


def test_store(spark, tmp_path):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "question_id string, answer string")
    store.export_predictions(p, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text()) == {"a": {"answer": "x"}, "b": {"answer": "y"}}
    assert {(r.question_id, r.answer) for r in store.read_predictions(spark, str(tmp_path / "p.json")).collect()} == {("a", "x"), ("b", "y")}
    store.save_predictions(p.limit(1), str(tmp_path / "run"))
    assert store.remaining(p, spark.read.parquet(str(tmp_path / "run"))).count() == 1
    (tmp_path / "g.json").write_text('[{"_id": "a", "context": [["T", ["x"]]]}]')
    assert store.read_gold(spark, [str(tmp_path / "g.json"), str(tmp_path / "none.json")]).first().context.replace(" ", "") == '[["T",["x"]]]'
    with pytest.raises(FileNotFoundError):
        store.read_gold(spark, [str(tmp_path / "none.json")])


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"retrieval": {"alpha": 0.7, "unknown": 1}, "other": 2}')
    assert config.load(str(tmp_path / "c.json")).retrieval.alpha == 0.7
    (tmp_path / "c.json").write_text('{"retrieval": {"alpha": 7}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))


def test_stream_scores_each_prediction_once(spark, tmp_path):
    from askmill.streaming.scoring import score_stream

    sf = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{sf}/predictions.parquet")
    p.repartition(2).write.parquet(str(tmp_path / "in"))
    examples = spark.read.parquet(f"{sf}/examples.parquet")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        score_stream(stream, examples, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("pred_id").distinct().count() > 0
    assert scoring.run_counts(p).count() > 0


def test_intermediate_tables_are_cleared(spark):
    import os

    from askmill.plans import workspace

    t = workspace.settle(spark.range(3), "kept")
    folder = workspace._tables(spark).removeprefix("file://")
    assert t.count() == 3 and os.listdir(folder)
    other = spark.range(2)
    workspace.clear(spark)
    assert not os.path.exists(folder) and workspace.settle(other, "again").count() == 2


def test_small_operators(spark):
    from askmill.operators import passages as P
    from askmill.operators import retrieval as R

    df = spark.createDataFrame([(i, f"T{i}", ["a", None]) for i in (5, 3, 9)], "passage_idx long, title string, sentences array<string>")
    assert [r.passage_idx for r in P.load(df, "passage_idx", 2).collect()] == [3, 5] and P.load(df, "passage_idx").count() == 3
    c = P.Collection(df, "passage_idx")
    assert len(c) == 3 and c[0].passage_idx == 3 and c[-1].passage_idx == 9 and [r.position for r in c] == [0, 1, 2] and repr(c) == "Collection(3 rows)"
    with pytest.raises(IndexError):
        c[3]
    with pytest.raises(ValueError):
        R.indexed(df.limit(0))
    with pytest.raises(ValueError):
        scoring.evaluate(spark.read.parquet("/root/testdata/sf0.001/predictions.parquet").limit(0), spark.read.parquet("/root/testdata/sf0.001/examples.parquet"))
    m = spark.createDataFrame([("r", "a b", "a b", "x"), ("r", "", "a", "x")], "run_name string, answer string, gold_answer string, gold string")
    got = scoring.model_similarity(m, lambda a, b: F.struct(F.lit(0.5).alias("p"), F.lit(0.6).alias("r"), F.lit(0.86).alias("f"))).first()
    assert (got.precision, got.recall, got.mean, got.ge90, got.ge85) == (0.5, 0.6, 0.86, 0.0, 0.5)
