"""The whole batch run: questions to predictions, as DataFrame stages with bounded retries and resume.

    retrieve (two hops) -> rerank -> select sentences -> prompt -> generate -> check -> ask again with feedback -> decide

Every stage takes all questions that are left; second attempts and their checks run on unsupported answers only.  A failed
call makes one prediction that says so, not a failed job.  Predictions append to a Parquet table, and a run started again
leaves out the questions found there before anything is retrieved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.config import Settings
from askmill.functions import text as X
from askmill.operators import answers as A
from askmill.operators import evidence as E
from askmill.operators import generation as G
from askmill.operators import passages as P
from askmill.operators.scoring import last_by
from askmill.plans import retrieval as R
from askmill.plans.workspace import settle
from askmill.sources import store
from askmill.sources.connectors import Factory, FakeClient, model_scorer


def _evidence(selected: DataFrame) -> DataFrame:
    e = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", F.concat(F.coalesce("title", F.lit("")), F.lit("::"), F.col("idx").cast("string")).alias("i"), "text"))).alias("e"))
    return e.select("query_id", F.transform("e", lambda x: x["i"]).alias("ids"), F.transform("e", lambda x: x["text"]).alias("texts"))


def _checked(generated: DataFrame, evidence: DataFrame, s: Settings, make: Factory) -> DataFrame:
    cited = F.transform(A.deduplicated(F.col("facts")), lambda f: F.concat(f["title"], F.lit("::"), f["sentence_index"].cast("string")))
    v = s.verifier
    rows = generated.withColumn("cited", cited).join(evidence, "query_id", "left")
    at = {"claim_at": v.claim_threshold, "support_at": v.support_threshold, "ratio_at": v.min_supported_claim_ratio, "most": v.max_claims}
    if v.mode == "overlap":
        return A.verify(rows, "answer", "ids", "texts", "cited", **at)
    return G.verified(settle(rows, "to-check"), "query_id", make, v.mode, "answer", "ids", "texts", "cited", **at)


CHECKS = {"support_score": "double", "is_supported": "boolean", "unsupported": "array<string>", "claims": "int", "coverage": "double", "ids": "array<string>", "texts": "array<string>", "cited": "array<string>"}


def predict(questions: DataFrame, candidates: DataFrame, make: Factory, settings: Settings | None = None, use_model_scorer: bool = False) -> DataFrame:
    """Predictions of ``questions`` (query_id, question, gold_answer) from ranked ``candidates`` (query_id, id, rank, title, sentences, passage_id).

    A question without candidates can't be answered and gets no facts.
    """
    s = settings or Settings()
    scorer = model_scorer(make) if use_model_scorer else E.lexical_scorer
    cands = candidates.withColumnRenamed("rank", "retrieval_rank").join(questions.select("query_id", "question"), "query_id")
    reranked = settle(E.rerank(cands, scorer, s.reranker.top_k), "reranked")
    how = E.Selection(s.reranker.sentence_score_threshold, s.reranker.max_sentences_per_passage, s.reranker.sentence_passage_limit, s.reranker.title_overlap_boost)
    selected = settle(E.select_sentences(reranked, scorer, how), "selected")
    prompts = settle(E.prompts(reranked, selected, s.prompt_builder.max_evidence_chars, s.prompt_builder.evidence_first, how=E.Routing(split=s.prompt_builder.complexity_routing_threshold)), "prompts")
    g, v, evidence = s.generator, s.verifier, settle(_evidence(selected), "evidence")

    def attempt(rows: DataFrame) -> DataFrame:
        if g.specialist_mode:
            said = G.generate_specialist(rows, make, g.model_small, g.model_large)
        else:
            said = G.generate(rows, make, g.model_small, g.model_large, (s.prompt_builder.temperature_small_model, s.prompt_builder.temperature_large_model), g.retry_on_parse_failure)
        if g.validate_citations:  # a diagnostic: what was cited though it wasn't offered
            offered = F.transform(F.map_values(F.coalesce("mapping", F.create_map().cast("map<int,struct<title:string,idx:int>>"))), lambda f: F.struct(f["title"].alias("title"), f["idx"].alias("sentence_index")))
            said = said.withColumn("invalid", F.size(A.invalid_citations(F.col("facts"), offered)))
        return said

    def checked(rows: DataFrame, name: str) -> DataFrame:
        if not v.enabled:
            return settle(rows.withColumns({c: F.lit(None).cast(t) for c, t in CHECKS.items()}), name)
        return settle(_checked(rows, evidence, s, make), name)

    done = checked(attempt(prompts), "first")
    retry = v.enabled and v.retry_on_failure
    failed = F.col("response").isNull()

    def again(done: DataFrame, when, name: str, with_answer: bool) -> DataFrame:
        """The rows that ``when`` picks, generated and checked once more with feedback; they stand even if they score less."""
        bad = done.where(when)
        if bad.isEmpty():  # of written tables: cheaper than the passes it may spare
            return done
        asked = prompts.join(bad.select("query_id", F.col("answer").alias("_last")), "query_id")
        asked = G.with_feedback(asked, "_last" if with_answer else None).drop("_last")
        return done.where(~when).unionByName(checked(attempt(asked), name), allowMissingColumns=True)

    for i in range(v.max_verification_retries if retry else 0):
        # an attempt is good enough if it is supported or scores at the threshold; a failed call ends the attempts
        done = again(done, ~F.col("is_supported") & (F.col("support_score") < v.retry_score_threshold) & ~failed, f"retry-{i}", True)
    if retry:
        done = again(done, ~F.col("is_supported") & ~failed, "last", False)
    top = reranked.groupBy("query_id").agg(F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct("rank", "title", "sentences", "passage_id"))).alias("ps"))
    facts = A.deduplicated(F.col("facts"))
    decision = A.decide(F.col("answer"), F.col("support_score"), F.col("is_supported"), F.col("top"), v.abstain_on_unsupported)
    rows = questions.join(done, "query_id", "left").join(top, "query_id", "left").withColumn("d", decision)
    found, none = F.col("ps").isNotNull(), F.array().cast("array<struct<title:string,sentence_index:int>>")
    when = lambda c: F.when(found, c)
    return rows.select(
        F.col("query_id").alias("question_id"), "question", "gold_answer", F.when(found, F.col("d.answer")).otherwise(A.CANNOT).alias("answer"), F.coalesce(facts, none).alias("sp"), F.col("response").alias("full_response"),
        when(F.struct("support_score", "is_supported", F.col("unsupported").alias("unsupported_claims"), F.size("ids").alias("evidence_count"), F.col("claims").alias("num_claims"), F.col("coverage").alias("supporting_fact_coverage"))).alias("verification"),
        when(F.struct(F.col("d.confidence").alias("confidence"), F.col("d.supported").alias("verifier_supported"), A.passage_ids(F.col("facts"), F.col("ps")).alias("supporting_passage_ids"))).alias("decision"),
    )


def questions_of(spark: SparkSession, sf: str, limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Each question once; the first ``limit`` in stored order if one is set, of these the ones listed in ``ids`` (id)."""
    e = last_by(spark.read.parquet(f"{sf}/examples.parquet").select("row_id", "id", "question", "answer", "question_type"), ["id"], "row_id")
    if limit is not None:
        e = P.load(e, "row_id", limit)
    if ids is not None:
        e = e.join(ids.select("id"), "id", "left_semi")
    c = lambda n: F.coalesce(n, F.lit(""))
    return e.select(F.col("row_id").alias("query_id"), c("question").alias("question"), c("answer").alias("gold_answer"), c("question_type").alias("type"))


def run(spark: SparkSession, sf: str, make: Factory = FakeClient, settings: Settings | None = None, save_to: str | None = None, index: str | None = None, limit: int | None = None, ids: DataFrame | None = None, model_entities: bool = False) -> DataFrame:
    """Predictions of the questions of the examples table; with ``save_to`` only of those not saved yet.

    ``index``: a folder with a saved index of these passages; it is made and saved there where it isn't.
    """
    s = settings or Settings()
    q = questions_of(spark, sf, limit, ids)
    if save_to:
        try:
            q = store.remaining(q, spark.read.parquet(save_to).select(F.col("question_id").alias("query_id")), "query_id")
        except Exception as e:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    q = settle(q, "asked")
    tables = store.load_index(spark, index, "passages") if index else None
    if tables is None:
        tables = R.index_tables(spark, sf)
        if index:
            store.save_index(index, "passages", *tables, dim=R.DIM)
    hits = R.retrieve(spark, sf, q, tables, s.retrieval, make if model_entities else None, s.generator.extraction_model)
    p = spark.read.parquet(f"{sf}/passages.parquet").select(F.col("passage_idx").alias("id"), X.strip("title").alias("title"), "sentences", "passage_id")
    out = predict(q.drop("type"), hits.select("query_id", "id", "rank").join(p, "id"), make, s)
    if save_to:
        store.save_predictions(out, save_to)
        return spark.read.parquet(save_to)
    return out


def pipeline_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with the deterministic client."""
    return run(spark, sf).select("question_id", "answer", F.size("sp").alias("facts"), "verification.is_supported", "decision.confidence")


QUERIES = {"pipeline_answers": pipeline_answers}
SQL: dict[str, str] = {}
