"""Queries over passages, examples and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.config import Retrieval
from askmill.functions import scores as S
from askmill.functions import text as X
from askmill.operators import generation as G
from askmill.operators import passages as P
from askmill.operators import retrieval as R
from askmill.operators.scoring import last_by
from askmill.plans import sqltext as Q
from askmill.plans.workspace import settle
from askmill.sources.connectors import Factory

POOL, TOP, DIM = 100, 20, 64
ALPHAS = {"alpha": 0.5, "bridge": 0.4, "comparison": 0.6}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each question once: the last delivery of its id."""
    e = last_by(_t(spark, sf, "examples").select("row_id", "id", "question", "question_type"), ["id"], "row_id")
    return e.select(F.col("row_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("question_type", F.lit("")).alias("type"))


def _text() -> "F.Column":
    return X.title_text(F.col("title"), F.col("sentences"))


def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "passages")
    idf = R.idf_table(R.term_counts(p, "passage_idx", _text()), p.count())
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _keywords(spark: SparkSession, sf: str, k: int, q: DataFrame | None = None, weights: DataFrame | None = None, passages: DataFrame | None = None) -> DataFrame:
    p = _t(spark, sf, "passages") if passages is None else passages
    return R.best_by_keywords(R.weighted(p, "passage_idx", _text()) if weights is None else weights, p, "passage_idx", q if q is not None else questions(spark, sf), "query_id", F.col("question"), k)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _keywords(spark, sf, TOP).select("query_id", F.col("id").alias("passage_idx"), "score", F.col("rank").cast("int").alias("rank"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "dense_vectors")
    return R.usable_vectors(v.withColumn("pv", F.struct("passage_idx", "vec_id")), "pv", "embedding", DIM).select(F.col("id.passage_idx").alias("id"), F.col("id.vec_id").alias("vec_id"), "v")


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The query vector of a question is the usable vector whose vec_id is its number (a stand-in pairing)."""
    v = _vectors(spark, sf)
    q = questions(spark, sf).select("query_id").join(v.select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    return R.best_by_vectors(v.select("id", "v"), q, k, DIM)


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, TOP).select("query_id", F.col("id").alias("passage_idx"), "score", F.col("rank").cast("int").alias("rank"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(_keywords(spark, sf, POOL), _dense(spark, sf, POOL), POOL, F.lit(ALPHAS["alpha"]), TOP)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", F.col("id").alias("passage_idx"), F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"), "bm25_score", "dense_score", "confidence")


def results_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Fuses the stored keyword and vector scores of each run and question, alpha by question type.

    Repeated rows count once (first result); a hot question is one window key whose rows Spark spills, and
    only its best TOP rows leave the map side.
    """
    r = _t(spark, sf, "retrieval_results").where("bm25_score IS NOT NULL AND dense_score IS NOT NULL")
    once = r.groupBy("run_name", "query_id", "passage_idx").agg(F.min_by(F.struct("bm25_score", "dense_score"), "result_id").alias("s")).select("run_name", "query_id", "passage_idx", "s.*")
    types = last_by(_t(spark, sf, "examples").select("row_id", "id", "question_type"), ["id"], "row_id").select(F.col("id").alias("query_id"), "question_type")
    key = ["run_name", "query_id"]
    a = R.ranked(once, key, "bm25_score", "passage_idx").withColumnRenamed("rank", "rk")
    b = R.ranked(a, key, "dense_score", "passage_idx").withColumnRenamed("rank", "rd").join(types, "query_id", "left")
    alpha = R.alpha_for(F.coalesce("question_type", F.lit("")), **ALPHAS)
    s = b.withColumn("score", F.round(alpha * S.rrf(F.col("rd")) + (1 - alpha) * S.rrf(F.col("rk")), 9))
    return R.ranked(s, key, "score", "passage_idx", TOP).select(*key, "passage_idx", "score", F.col("rank").cast("int").alias("rank"))


def results_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How far the best stored score of each run and question is ahead of the second."""
    r = _t(spark, sf, "retrieval_results").where("score IS NOT NULL").groupBy("run_name", "query_id", "passage_idx").agg(F.max("score").alias("score"))
    two = R.ranked(r, ["run_name", "query_id"], "score", "passage_idx", 2)
    return two.groupBy("run_name", "query_id").agg(F.round(S.confidence(F.max(F.when(F.col("rank") == 0, F.col("score"))), F.max(F.when(F.col("rank") == 1, F.col("score")))), 6).alias("confidence"))


def merged_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results of both hops merged: the first hop that has a passage wins, best TOP by score, then hop and rank."""
    r = _t(spark, sf, "retrieval_results").where("score IS NOT NULL AND hit_rank IS NOT NULL AND hop IS NOT NULL")
    first = r.groupBy("run_name", "query_id", "passage_idx").agg(F.min_by(F.struct("score", "hop", "hit_rank", "result_id"), F.struct("hop", "hit_rank", "result_id")).alias("s")).select("run_name", "query_id", "passage_idx", "s.*")
    from pyspark.sql import Window

    w = Window.partitionBy("run_name", "query_id").orderBy(F.desc("score"), "hop", "hit_rank", "result_id")
    return first.withColumn("rank", (F.row_number().over(w) - 1)).where(F.col("rank") < TOP).select("run_name", "query_id", "passage_idx", "hop", "rank")


def stage_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of cited titles among retrieved titles by run: mean, perfect and zero."""
    e = last_by(_t(spark, sf, "examples").select("row_id", "id", "supporting_facts"), ["id"], "row_id")
    gold = e.select(F.col("id").alias("query_id"), F.explode("supporting_facts").alias("f")).select("query_id", X.strip("f.title").alias("title")).where("title <> ''").distinct()
    r = _t(spark, sf, "retrieval_results").select("run_name", "query_id", "passage_idx").distinct()
    titles = _t(spark, sf, "passages").select("passage_idx", X.strip("title").alias("title")).where("title <> ''")
    got = r.join(titles, "passage_idx").select("run_name", "query_id", "title").distinct()
    asked = r.select("run_name", "query_id").distinct().join(gold, "query_id")
    per = asked.join(got.withColumn("hit", F.lit(1)), ["run_name", "query_id", "title"], "left").groupBy("run_name", "query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per.groupBy("run_name").agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if(F.col("recall") == 1).alias("perfect"), F.count_if(F.col("recall") == 0).alias("zero"))


def full_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return P.full_contexts(_t(spark, sf, "examples"))


def first_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred records in stored order."""
    return P.load(_t(spark, sf, "examples").select("row_id", "id"), "row_id", 100)


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(S.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def bridge_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "examples").select("row_id", F.coalesce("question", F.lit("")).alias("q"), F.posexplode("contexts").alias("pos", "c")).where(F.col("c").isNotNull())
    return e.select("row_id", "pos", F.posexplode(X.bridge_entities(F.col("c.title"), F.col("c.sentences"), F.col("q"))).alias("place", "entity"))


def _entities(spark: SparkSession, sf: str, hop1: DataFrame, q: DataFrame, most: int, make: Factory | None = None, model: str = "large") -> DataFrame:
    """(query_id, pos, entity) of the five best passages of each question: by a model, or by patterns where there is none."""
    p = _t(spark, sf, "passages").select(F.col("passage_idx").alias("id"), "title", "sentences")
    best = hop1.where("rank < 5").join(p, "id").join(q, "query_id")
    if make is not None:
        return G.extract_entities(best.select("query_id", "question", "rank", "title", "sentences"), make, model, most)
    named = best.select("query_id", "rank", F.posexplode(X.bridge_entities(F.col("title"), F.col("sentences"), F.col("question"), most)).alias("at", "entity"))
    return named.groupBy("query_id", "entity").agg(F.min(F.col("rank") * 10 + F.col("at")).cast("int").alias("pos"))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return P.title_index(_t(spark, sf, "passages")).select("title")


def fuzzy_title_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three most similar titles of each question's quoted name (its longest capitalised run)."""
    name = F.regexp_extract("question", r"((?:[A-Z][\w'-]+)(?: (?:of |the )?[A-Z][\w'-]+)*)(?!.*[A-Z])", 1)
    e = questions(spark, sf).select("query_id", F.lit(0).alias("pos"), name.alias("entity")).where("entity <> ''")
    return R.similar_titles(e, _titles(spark, sf)).select("query_id", "entity", "title", F.round("score", 4).alias("score"))


def index_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, weights, vectors) of the distinct passages: of each title and text the first stored one stands for its copies."""
    firsts = settle(P.first_of(R.indexed(_t(spark, sf, "passages"))), "firsts")
    p = settle(_t(spark, sf, "passages").join(firsts.where("passage_idx = first").select("passage_idx"), "passage_idx", "left_semi"), "distinct")
    v = _vectors(spark, sf).join(firsts.withColumnRenamed("passage_idx", "id"), "id").groupBy("first").agg(F.min_by("v", F.struct("id", "vec_id")).alias("v"))
    return p, settle(R.weighted(p, "passage_idx", _text()), "weights"), settle(v.withColumnRenamed("first", "id"), "vectors")


def retrieve(spark: SparkSession, sf: str, q: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], how: Retrieval = Retrieval(), make: Factory | None = None, model: str = "large") -> DataFrame:
    """(query_id, id, score, rank, hop, confidence) of both hops for questions (query_id, question, type).

    The second hop, its entities and its ranking are made for the questions alone whose first hop isn't confident.
    """
    p, weights, vectors = tables
    own = q.select("query_id").join(_vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    dense = settle(R.best_by_vectors(vectors, own, how.candidate_pool_size, DIM), "dense")
    types = q.select("query_id", "type")

    def fused(asked: DataFrame) -> DataFrame:
        k = R.best_by_keywords(weights, p, "passage_idx", asked, "query_id", F.col("question"), how.candidate_pool_size)
        alpha = R.alpha_for(F.coalesce("type", F.lit("")), how.alpha, how.alpha_bridge, how.alpha_comparison)
        near = dense.join(asked.select("query_id"), "query_id", "left_semi")
        return R.fuse(k, near, how.candidate_pool_size, alpha, how.top_k, how.rrf_k, types)

    hop1 = settle(fused(q), "hop1")
    unsure = q.join(hop1.where((F.col("rank") == 0) & (F.col("confidence") <= how.hop2_confidence)).select("query_id"), "query_id", "left_semi")
    unsure = settle(unsure, "unsure")
    entities = settle(_entities(spark, sf, hop1.join(unsure.select("query_id"), "query_id", "left_semi"), unsure, how.max_bridge_entities, make, model), "entities")
    more = entities.groupBy("query_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]), 1, how.max_bridge_entities), " ").alias("more"))
    again = settle(fused(unsure.join(more, "query_id").select("query_id", F.concat("question", F.lit(" "), "more").alias("question"), "type")), "again")
    members = p.select(X.strip("title").alias("title"), F.col("passage_idx").alias("id"))
    return R.second_hop(hop1, entities, P.title_index(p).select("title"), members, again, how.top_k, how.hop2_confidence, how.fuzzy_title_threshold)


def multihop(spark: SparkSession, sf: str) -> DataFrame:
    """Both hops over the distinct passages."""
    found = retrieve(spark, sf, questions(spark, sf), index_tables(spark, sf))
    return found.select("query_id", F.col("id").alias("passage_idx"), F.round("score", 6).alias("score"), "rank", "hop")


def dense_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of every vector with the first three usable ones."""
    v = _vectors(spark, sf)
    q = v.orderBy("vec_id").limit(3).select(F.col("vec_id").alias("query_id"), "v")
    return R.vector_scores(v.select(F.col("vec_id").alias("id"), "v"), q).withColumnRenamed("id", "vec_id")


def parsed_raw(spark: SparkSession, sf: str) -> DataFrame:
    d = P.parse_raw(_t(spark, sf, "raw_examples"))
    return d.select("row_id", "id", "question", "answer", F.size("contexts").alias("contexts"), F.size("supporting_facts").alias("facts"), "question_type", "question_level")


def all_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed and raw records in one table, by source file (several splits)."""
    e = _t(spark, sf, "examples").select("row_id", "id", "question", "source_file")
    raw = P.parse_raw(_t(spark, sf, "raw_examples")).select("row_id", "id", "question", "source_file")
    return e.unionByName(raw).groupBy("source_file").agg(F.count("*").alias("examples"), F.count_distinct("id").alias("ids"))


def exported(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "examples")
    return e.select("row_id", F.to_json(F.struct("id", "question", "answer", "contexts", "supporting_facts", "question_type", "question_level")).alias("record"))


QUERIES = {
    "passage_build": lambda s, sf: P.passage_texts(_t(s, sf, "passages")),
    "passage_index": lambda s, sf: P.passage_index(_t(s, sf, "passages")),
    "title_index": lambda s, sf: P.title_index(_t(s, sf, "passages")),
    "corpus_stats": lambda s, sf: P.corpus_stats(_t(s, sf, "examples")),
    "gold_contexts": lambda s, sf: P.contexts_of(_t(s, sf, "examples"), True),
    "distractor_contexts": lambda s, sf: P.contexts_of(_t(s, sf, "examples"), False),
    "gold_sentences": lambda s, sf: P.gold_sentences(_t(s, sf, "examples")),
    "parsed_raw": parsed_raw,
    "all_examples": all_examples,
    "exported_examples": exported,
    "bm25_idf": bm25_idf,
    "bm25_topk": bm25_topk,
    "dense_topk": dense_topk,
    "rrf_fusion": rrf_fusion,
    "results_fusion": results_fusion,
    "results_confidence": results_confidence,
    "merged_hops": merged_hops,
    "stage_recall": stage_recall,
    "l2_normalize": l2_normalize,
    "dense_scores": dense_scores,
    "full_contexts": full_contexts,
    "first_examples": first_examples,
    "bridge_entities": bridge_entities,
    "fuzzy_title_topk": fuzzy_title_topk,
    "multihop": multihop,
}

_QUESTIONS = "q AS (SELECT row_id query_id, coalesce(question, '') question FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) rn FROM examples) WHERE rn = 1)"
_TERMS = f"""d AS (SELECT passage_idx, {Q.words(Q.strip('lower(' + Q.title_text('title', 'sentences') + ')'))} terms FROM passages),
t AS (SELECT passage_idx, len, term, count(*) tf FROM (SELECT passage_idx, len(terms) len, unnest(terms) term FROM d) GROUP BY ALL),
r AS (SELECT term, count(*) df, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) raw FROM t GROUP BY term),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END idf FROM r)"""
_BM25 = f"""{_QUESTIONS}, {_TERMS},
w AS (SELECT passage_idx, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len(terms)) FROM d))) w FROM t JOIN i USING (term)),
qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({Q.words(Q.strip('lower(question)'))}) term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, passage_idx, sum(w * qtf) s FROM qt JOIN w USING (term) GROUP BY ALL),
k0 AS (SELECT q.query_id, d.passage_idx, round(coalesce(s, 0), 6) score FROM q CROSS JOIN d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.passage_idx = d.passage_idx),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_idx) - 1)::INT rank FROM k0)"""
_VECTORS = """v0 AS (SELECT passage_idx, vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM dense_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT passage_idx, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) u FROM v0)"""
_DENSE = f"""{_VECTORS}, n0 AS (SELECT q.query_id, b.passage_idx, round(list_dot_product(a.u, b.u), 6) + 0.0 score FROM q JOIN v a ON a.vec_id = q.query_id CROSS JOIN v b),
n AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_idx) - 1)::INT rank FROM n0)"""
_CONF = "CASE WHEN {1} IS NOT NULL AND {0} > 0 THEN least(1.0, greatest(0.0, ({0} - {1}) / {0})) ELSE 0.0 END"
_S = "coalesce(supporting_facts, [])"

_RJ = "r AS (SELECT row_id, source_file, payload, CASE WHEN json_valid(payload) THEN payload::JSON END j FROM raw_examples)"
_FIRST = lambda *ks: "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') <> 'NULL' THEN nullif(json_extract_string(j, '$.{k}'), '') END" for k in ks) + ", '')"
_TITLED = lambda e: f"(json_type({e}) = 'ARRAY' AND json_array_length({e}) = 2) OR (json_type({e}) = 'OBJECT' AND json_extract_string({e}, '$.title') IS NOT NULL)"
_COUNT = lambda key: f"CASE WHEN json_type(j, '$.{key}') = 'ARRAY' THEN len(list_filter(json_extract(j, '$.{key}[*]'), lambda e: {_TITLED('e')})) ELSE 0 END::INT"

SQL = {
    "first_examples": "SELECT row_id, id FROM examples ORDER BY row_id LIMIT 100",
    "full_contexts": f"SELECT row_id, coalesce(array_to_string(list_transform(list_filter(contexts, lambda c: c IS NOT NULL), lambda c: {Q.title_text('c.title', 'c.sentences')}), chr(10)), '') \"text\" FROM examples",
    "parsed_raw": f"""WITH {_RJ} SELECT row_id, {_FIRST('_id', 'id')} id, {Q.strip(_FIRST('question'))} question, {Q.strip(_FIRST('answer'))} answer, {_COUNT('context')} contexts, {_COUNT('supporting_facts')} facts, {_FIRST('type', 'question_type')} question_type, {_FIRST('level')} question_level FROM r""",
    "all_examples": f"""WITH {_RJ}, a AS (SELECT id, source_file FROM examples UNION ALL SELECT {_FIRST('_id', 'id')}, source_file FROM r) SELECT source_file, count(*) examples, count(DISTINCT id) ids FROM a GROUP BY source_file""",
    "passage_build": f"SELECT passage_idx, {Q.joined_text('sentences')} text, {Q.title_text('title', 'sentences')} title_text FROM passages",
    "passage_index": f"WITH r AS (SELECT passage_idx, coalesce({Q.strip('title')}, '') t, {Q.joined_text('sentences')} x FROM passages), f AS (SELECT t, min(passage_idx) passage_idx, count(*) copies FROM r GROUP BY t, x), n AS (SELECT *, row_number() OVER (ORDER BY passage_idx) - 1 AS \"position\" FROM f) SELECT passage_idx, t || '::' || \"position\" passage_id, copies, \"position\" FROM n",
    "title_index": f"SELECT {Q.strip('title')} title, count(*) passages, min(passage_idx) first_idx FROM passages WHERE {Q.strip('title')} <> '' GROUP BY 1",
    "corpus_stats": f"""SELECT 'examples' name, count(*)::DOUBLE AS "value" FROM examples UNION ALL SELECT 'avg_contexts', round(coalesce(avg(coalesce(len(contexts), 0)), 0), 6) FROM examples UNION ALL SELECT 'avg_facts', round(coalesce(avg(coalesce(len(supporting_facts), 0)), 0), 6) FROM examples
UNION ALL SELECT 'unique_passages', count(*)::DOUBLE FROM (SELECT DISTINCT coalesce(c.title, ''), {Q.joined_text('c.sentences')} FROM (SELECT unnest(contexts) c FROM examples) WHERE c IS NOT NULL)
UNION ALL SELECT 'type:' || coalesce(question_type, ''), count(*)::DOUBLE FROM examples GROUP BY 1 UNION ALL SELECT 'level:' || coalesce(question_level, ''), count(*)::DOUBLE FROM examples GROUP BY 1""",
    "gold_contexts": f"SELECT row_id, pos::INT pos, c.title title FROM (SELECT row_id, supporting_facts, unnest(contexts) c, generate_subscripts(contexts, 1) - 1 pos FROM examples) WHERE c IS NOT NULL AND coalesce(list_contains(list_transform({_S}, lambda f: f.title), c.title), false)",
    "distractor_contexts": f"SELECT row_id, pos::INT pos, c.title title FROM (SELECT row_id, supporting_facts, unnest(contexts) c, generate_subscripts(contexts, 1) - 1 pos FROM examples) WHERE c IS NOT NULL AND NOT coalesce(list_contains(list_transform({_S}, lambda f: f.title), c.title), false)",
    "gold_sentences": """WITH f AS (SELECT row_id, contexts, unnest(supporting_facts) f, generate_subscripts(supporting_facts, 1) - 1 fact_pos FROM examples),
c AS (SELECT row_id, fact_pos, f.sentence_index i, list_filter(contexts, lambda c: c.title = f.title)[-1].sentences s FROM f WHERE f.title IS NOT NULL)
SELECT row_id, fact_pos::INT fact_pos, s[i + 1] sentence FROM c WHERE i >= 0 AND s[i + 1] IS NOT NULL""",
    "bm25_idf": f"WITH {_TERMS} SELECT term, df, round(idf, 6) idf FROM i",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM k WHERE rank < {TOP}",
    "dense_topk": f"WITH {_QUESTIONS}, {_DENSE} SELECT * FROM n WHERE rank < {TOP}",
    "rrf_fusion": f"""WITH {_BM25}, {_DENSE},
f AS (SELECT query_id, passage_idx, round(0.5 / (20 + coalesce(n.rank, {POOL}) + 1) + 0.5 / (20 + coalesce(k.rank, {POOL}) + 1), 9) score, coalesce(k.score, 0.0) bm25_score, coalesce(n.score, 0.0) dense_score FROM (SELECT * FROM k WHERE rank < {POOL}) k FULL JOIN (SELECT * FROM n WHERE rank < {POOL}) n USING (query_id, passage_idx)),
g AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_idx) - 1)::INT rank FROM f),
h AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) nxt FROM g WHERE rank < {TOP})
SELECT query_id, passage_idx, score, rank, bm25_score, dense_score, CASE WHEN rank = 0 THEN round({_CONF.format('score', 'nxt')}, 9) ELSE 0.0 END confidence FROM h""",
    "results_fusion": f"""WITH o AS (SELECT run_name, query_id, passage_idx, arg_min(bm25_score, result_id) b, arg_min(dense_score, result_id) d FROM retrieval_results WHERE bm25_score IS NOT NULL AND dense_score IS NOT NULL GROUP BY ALL),
e AS (SELECT id query_id, question_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) rn FROM examples) WHERE rn = 1),
r AS (SELECT o.*, CASE question_type WHEN 'bridge' THEN 0.4 WHEN 'comparison' THEN 0.6 ELSE 0.5 END::DOUBLE a, row_number() OVER (PARTITION BY run_name, o.query_id ORDER BY b DESC, passage_idx) - 1 rk, row_number() OVER (PARTITION BY run_name, o.query_id ORDER BY d DESC, passage_idx) - 1 rd FROM o LEFT JOIN e ON e.query_id = o.query_id),
s AS (SELECT run_name, query_id, passage_idx, round(a * (1.0::DOUBLE / (20 + rd + 1)) + (1 - a) * (1.0::DOUBLE / (20 + rk + 1)), 9) score FROM r)
SELECT *, (row_number() OVER (PARTITION BY run_name, query_id ORDER BY score DESC, passage_idx) - 1)::INT rank FROM s QUALIFY rank < {TOP}""",
    "results_confidence": f"""WITH r AS (SELECT run_name, query_id, passage_idx, max(score) score FROM retrieval_results WHERE score IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run_name, query_id ORDER BY score DESC, passage_idx) rk FROM r),
p AS (SELECT run_name, query_id, max(score) FILTER (rk = 1) a, max(score) FILTER (rk = 2) b FROM k WHERE rk <= 2 GROUP BY ALL) SELECT run_name, query_id, round({_CONF.format('a', 'b')}, 6) confidence FROM p""",
    "merged_hops": f"""WITH f AS (SELECT * FROM retrieval_results WHERE score IS NOT NULL AND hit_rank IS NOT NULL AND hop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_name, query_id, passage_idx ORDER BY hop, hit_rank, result_id) = 1)
SELECT run_name, query_id, passage_idx, hop, (row_number() OVER (PARTITION BY run_name, query_id ORDER BY score DESC, hop, hit_rank, result_id) - 1)::INT rank FROM f QUALIFY rank < {TOP}""",
    "stage_recall": f"""WITH e AS (SELECT * FROM examples QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1), g AS (SELECT DISTINCT id query_id, {Q.strip('f.title')} title FROM (SELECT id, unnest(supporting_facts) f FROM e) WHERE {Q.strip('f.title')} <> ''),
r AS (SELECT DISTINCT run_name, query_id, passage_idx FROM retrieval_results), h AS (SELECT DISTINCT run_name, query_id, {Q.strip('title')} title FROM r JOIN passages USING (passage_idx) WHERE {Q.strip('title')} <> ''),
p AS (SELECT a.run_name, a.query_id, avg((h.title IS NOT NULL)::INT) recall FROM (SELECT DISTINCT run_name, query_id FROM r) a JOIN g USING (query_id) LEFT JOIN h ON h.run_name = a.run_name AND h.query_id = a.query_id AND h.title = g.title GROUP BY ALL)
SELECT run_name, count(*) questions, round(avg(recall), 6) mean_recall, count(*) FILTER (recall = 1) perfect, count(*) FILTER (recall = 0) zero FROM p GROUP BY run_name""",
    "dense_scores": f"WITH {_VECTORS}, q AS (SELECT vec_id query_id, u w FROM v ORDER BY vec_id LIMIT 3) SELECT query_id, vec_id, round(list_dot_product(u, w), 6) score FROM q CROSS JOIN v",
    "l2_normalize": f'WITH {_VECTORS} SELECT vec_id, round(u[1], 6) "first", round(list_dot_product(u, u), 6) norm FROM v',
}
