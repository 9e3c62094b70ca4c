"""Queries from candidates to decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.functions import scores as S
from askmill.functions import text as X
from askmill.operators import answers as A
from askmill.operators import evidence as E
from askmill.operators.scoring import last_by, recall_of
from askmill.plans import sqltext as Q
from askmill.plans.workspace import settle


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage a run retrieved for a gold question, ranked by its best stored score."""
    q = last_by(_t(spark, sf, "examples").select("row_id", "id", "question"), ["id"], "row_id").select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"))
    r = _t(spark, sf, "retrieval_results").where("score IS NOT NULL").groupBy("query_id", "passage_idx").agg(F.max("score").alias("best"))
    p = _t(spark, sf, "passages").select(F.col("passage_idx").alias("id"), "title", "sentences")
    return r.join(q, "query_id").withColumnRenamed("passage_idx", "id").join(p, "id").withColumn("retrieval_rank", -F.col("best"))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    return E.rerank(candidates(spark, sf))


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", F.col("id").alias("passage_idx"), F.round("score", 6).alias("score"), "rank")


def sentence_select(spark: SparkSession, sf: str) -> DataFrame:
    return E.select_sentences(_reranked(spark, sf)).select("query_id", "rank", "idx", "score")


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = settle(_reranked(spark, sf), "reranked")
    return r, settle(E.select_sentences(r), "selected")


def facts_list(spark: SparkSession, sf: str) -> DataFrame:
    return E.fact_block(_both(spark, sf)[1]).select("query_id", "facts")


def evidence_block(spark: SparkSession, sf: str) -> DataFrame:
    return E.evidence_block(*_both(spark, sf))


def extract_claims(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "predictions")
    return p.select("pred_id", F.posexplode(X.claims(F.coalesce("answer", F.lit("")))).alias("pos", "claim"))


def lexical_support(spark: SparkSession, sf: str) -> DataFrame:
    """Support of each answer by its stored response."""
    c = lambda n: F.coalesce(n, F.lit(""))
    return _t(spark, sf, "predictions").select("pred_id", F.round(S.lexical_support(c("answer"), c("full_response")), 6).alias("support"))


def complexity_route(spark: SparkSession, sf: str) -> DataFrame:
    return E.complexity(*_both(spark, sf))


def built_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return E.prompts(*_both(spark, sf)).select("query_id", "prompt", "complexity", "route")


def prompt_metadata(spark: SparkSession, sf: str) -> DataFrame:
    r, s = _both(spark, sf)
    return E.prompt_facts(E.prompts(r, s), r, s)


def passage_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Selected sentences of each passage number, all of them."""
    m = E.passage_facts(_both(spark, sf)[1]).select("query_id", F.explode("mapping").alias("number", "facts"))
    return m.select("query_id", "number", F.array_join(F.transform("facts", lambda f: F.concat(F.coalesce(f["title"], F.lit("")), F.lit("::"), f["idx"].cast("string"))), "|").alias("facts"))


def stage_recalls(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the cited titles and facts of each question is left after retrieval, reranking, sentence choice and answering."""
    r, s = _both(spark, sf)
    asked = r.select("query_id").distinct()
    e = last_by(_t(spark, sf, "examples").select("row_id", "id", "supporting_facts"), ["id"], "row_id").select(F.col("id").alias("query_id"), F.explode("supporting_facts").alias("f"))
    item = lambda f: F.concat(f["title"], F.lit("::"), f["sentence_index"].cast("string")).alias("item")
    titles = asked.join(e.select("query_id", F.col("f.title").alias("item")).where("item IS NOT NULL"), "query_id", "left")
    facts = asked.join(e.select("query_id", item(F.col("f"))).where("item IS NOT NULL"), "query_id", "left")
    got = candidates(spark, sf).select("query_id", F.col("title").alias("item"))
    chosen = s.select("query_id", "rank", "title", "text").join(r.select("query_id", "rank", "sentences"), ["query_id", "rank"])
    chosen = chosen.select("query_id", F.concat("title", F.lit("::"), X.match_sentence(F.col("sentences"), F.col("text")).cast("string")).alias("item"))
    said = _t(spark, sf, "predictions").select(F.col("question_id").alias("query_id"), F.explode("sp").alias("f")).select("query_id", item(F.col("f")))
    parts = [("retrieval", titles, got), ("rerank", titles, r.select("query_id", F.col("title").alias("item"))), ("sentence", facts, chosen), ("prediction", facts, said)]
    found = [recall_of(stage, gold, had) for stage, gold, had in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def parse_output(spark: SparkSession, sf: str) -> DataFrame:
    """Parses every stored response; fact n is the n-th cited fact of the prediction."""
    p = _t(spark, sf, "predictions")
    facts = F.coalesce("sp", F.array().cast("array<struct<title:string,sentence_index:int>>"))
    mapping = F.map_from_entries(F.transform(facts, lambda f, i: F.struct(i.alias("n"), f.alias("f"))))
    parsed = p.select("pred_id", A.parse_response(F.col("full_response"), mapping).alias("r"))
    return parsed.select("pred_id", "r.answer", F.size("r.facts").alias("facts"), "r.stage")


def _with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each prediction of a gold question with that question's texts as evidence."""
    e = last_by(_t(spark, sf, "examples").select("row_id", "id", "contexts"), ["id"], "row_id")
    flat = e.select(F.col("id").alias("question_id"), F.posexplode("contexts").alias("c", "x")).where("x.title IS NOT NULL").select("question_id", "c", "x.title", F.posexplode("x.sentences").alias("s", "text")).where(X.strip("text") != "")
    ev = flat.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("c", "s", F.concat("title", F.lit("::"), F.col("s").cast("string")).alias("i"), "text"))).alias("ev"))
    ev = ev.select("question_id", F.transform("ev", lambda x: x["i"]).alias("ids"), F.transform("ev", lambda x: x["text"]).alias("texts"))
    cited = F.transform(A.deduplicated(F.col("sp")), lambda f: F.concat(f["title"], F.lit("::"), f["sentence_index"].cast("string")))
    return _t(spark, sf, "predictions").select("pred_id", "question_id", "answer", cited.alias("cited")).join(ev, "question_id")


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    v = A.verify(_with_evidence(spark, sf), "answer", "ids", "texts", "cited")
    return v.select("pred_id", F.round("support_score", 3).alias("support_score"), "is_supported", "claims", F.round("coverage", 4).alias("coverage"))


def decide(spark: SparkSession, sf: str) -> DataFrame:
    """Decision of each prediction from its stored check and the best stored score of its run and question."""
    r = _t(spark, sf, "retrieval_results").groupBy("run_name", F.col("query_id").alias("question_id")).agg(F.max("score").alias("top"))
    p = _t(spark, sf, "predictions").select("pred_id", "run_name", "question_id", "answer", "verification").join(r, ["run_name", "question_id"], "left")
    d = p.select("pred_id", A.decide(F.col("answer"), F.col("verification.support_score"), F.col("verification.is_supported"), F.col("top")).alias("d"))
    return d.select("pred_id", "d.answer", F.round("d.confidence", 3).alias("confidence"), "d.supported")


def dedupe_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "predictions").select("pred_id", A.deduplicated(F.col("sp")).alias("f")).where("f IS NOT NULL")
    return f.select("pred_id", F.array_join(F.transform("f", lambda x: F.concat(x["title"], F.lit("::"), x["sentence_index"].cast("string"))), "|").alias("facts"))


def decided_passages(spark: SparkSession, sf: str) -> DataFrame:
    e = last_by(_t(spark, sf, "examples").select("row_id", "id", "contexts"), ["id"], "row_id").select(F.col("id").alias("question_id"), F.filter("contexts", lambda c: c.isNotNull()).alias("contexts"))
    j = _t(spark, sf, "predictions").select("pred_id", "question_id", "sp").join(e, "question_id")
    return j.select("pred_id", F.explode(A.passage_ids(F.col("sp"), F.col("contexts"))).alias("passage_id"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Questions no run has answered yet: what a resumed job still has to do."""
    done = _t(spark, sf, "predictions").select(F.col("question_id").alias("id"))
    return _t(spark, sf, "examples").select("row_id", "id").join(done, "id", "left_anti")


def gold_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    done = _t(spark, sf, "predictions").select(F.col("question_id").alias("id"))
    return _t(spark, sf, "examples").select("row_id", "id").join(done, "id", "left_semi")


QUERIES = {f.__name__: f for f in (rerank_topk, sentence_select, evidence_block, facts_list, extract_claims, lexical_support, complexity_route, built_prompts, prompt_metadata, passage_facts, stage_recalls, parse_output, verify_claims, decide, dedupe_facts, decided_passages, resume_antijoin, gold_semijoin)}

_EX = "x AS (SELECT * FROM examples QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)"
_RER = f"""{_EX}, c AS (SELECT query_id, passage_idx, max(score) best FROM retrieval_results WHERE score IS NOT NULL GROUP BY ALL),
j AS (SELECT c.query_id, c.passage_idx, best, coalesce(x.question, '') question, p.title, p.sentences, {Q.overlap_terms(Q.strip("coalesce(x.question, '')"))} qt, {Q.overlap_terms(Q.strip(Q.title_text('p.title', 'p.sentences')))} pt FROM c JOIN x ON x.id = c.query_id JOIN passages p USING (passage_idx)),
s AS (SELECT *, {Q.ratio('len(list_intersect(qt, pt))', 'len(qt)')} score FROM j),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best DESC, passage_idx) - 1)::INT rank FROM s QUALIFY rank < 5)"""
_SEL = f"""{_RER}, u0 AS (SELECT query_id, passage_idx, title, rank, qt, unnest(sentences) raw, generate_subscripts(sentences, 1) - 1 idx FROM r WHERE rank < 3),
u1 AS (SELECT *, {Q.strip('raw')} text FROM u0 WHERE {Q.strip('raw')} <> ''), u2 AS (SELECT *, {Q.overlap_terms('text')} st, {Q.overlap_terms(Q.strip("coalesce(title, '')"))} tt FROM u1),
u3 AS (SELECT *, 1 / (1 + exp(-({Q.ratio('len(list_intersect(qt, st))', 'len(qt)')}))) + CASE WHEN len(list_intersect(tt, qt)) > 0 THEN 0.05::DOUBLE ELSE 0 END sc FROM u2),
u4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, passage_idx ORDER BY sc DESC, text DESC, idx DESC) - 1 n FROM u3),
sel AS (SELECT * FROM u4 WHERE n < CASE WHEN rank < 2 THEN 2 ELSE 1 END OR (sc >= 0.4 AND n < 5))"""
_KEYS = " OR ".join(f"contains(lower(question), '{w}')" for w in E.Routing().keywords)
_CLAIMS = rf"list_filter(list_transform(string_split_regex(regexp_replace({Q.joined(Q.words('a'))}, '([.?!;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c, ' -')), lambda c: c <> '')[1:6]"
_DEDUP = "f AS (SELECT pred_id, question_id, f.title t, f.sentence_index i, min(pos) pos FROM (SELECT pred_id, question_id, unnest(sp) f, generate_subscripts(sp, 1) pos FROM predictions) WHERE f.title IS NOT NULL AND f.sentence_index IS NOT NULL GROUP BY ALL)"

_LIMITED = "l AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY idx) k FROM sel QUALIFY k <= CASE WHEN rank < 2 THEN 3 ELSE 2 END), nf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) - 1 num FROM l)"
_SHOWN = "CASE WHEN length(text) > 180 THEN text[1:180] || '...' ELSE text END"
_BLOCKS = f"""{_LIMITED}, fa AS (SELECT query_id, 'AVAILABLE FACTS:' || chr(10) || string_agg('Fact ' || num || ': [' || coalesce(title, '') || ', ' || idx || '] ' || {_SHOWN}, chr(10) ORDER BY num) facts FROM nf GROUP BY query_id),
nl AS (SELECT query_id, rank, string_agg(chr(10) || '  [' || idx || '] ' || {_SHOWN}, '' ORDER BY idx) lines FROM l GROUP BY ALL),
ev AS (SELECT query_id, any_value(question) question, 'Evidence:' || chr(10) || string_agg('Passage ' || rank || ': [' || coalesce(title, '') || ']' || coalesce(lines, ''), chr(10) ORDER BY rank) evidence FROM r LEFT JOIN nl USING (query_id, rank) GROUP BY query_id)"""
_COMPLEX = f"""p AS (SELECT query_id, any_value(question) question, max(score) FILTER (rank = 0) a, max(score) FILTER (rank = 1) b FROM r GROUP BY query_id), m AS (SELECT query_id, count(*) n FROM sel GROUP BY query_id),
z AS (SELECT query_id, greatest(0.0, least(1.0, 0.10::DOUBLE * (length(question) > 50)::INT + 0.35::DOUBLE * ({_KEYS})::INT + 0.20::DOUBLE * CASE WHEN b IS NULL THEN 0.5 ELSE 1 - greatest(0.0, least(1.0, (a - b) / (abs(a) + 1e-6))) END + 0.35::DOUBLE * (coalesce(n, 0) > 5)::INT)) c FROM p LEFT JOIN m USING (query_id))"""
_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
_FILLED = lambda t: f"replace(replace({_QUOTED(t)}, '{{question}}', question), '{{facts}}', coalesce(facts, 'AVAILABLE FACTS:'))"
_YN = f"(NOT regexp_matches(lower({Q.strip('question')}), '^({X.ENTITY_STARTS})') AND regexp_matches(lower({Q.strip('question')}), '^({X.YESNO_STARTS})'))"
_PROMPTS = f"""{_SEL}, {_BLOCKS}, {_COMPLEX}, w AS (SELECT query_id, evidence || chr(10) || chr(10) || CASE WHEN {_YN} THEN {_FILLED(E.YESNO)} ELSE {_FILLED(E.CITATION)} END t FROM ev LEFT JOIN fa USING (query_id)),
pr AS (SELECT query_id, CASE WHEN length(t) > 6000 THEN t[1:6000] || chr(10) || '[... truncated ...]' ELSE t END prompt, round(c, 6) complexity, CASE WHEN c > 0.5 THEN 'complex' ELSE 'simple' END route FROM w JOIN z USING (query_id))"""
_RECALL = lambda stage, gold, got: f"SELECT '{stage}' stage, count(*) questions, round(avg(recall), 6) mean_recall, count(*) FILTER (recall >= 1) perfect, count(*) FILTER (recall <= 0) zero FROM (SELECT a.query_id, avg((h.item IS NOT NULL)::INT) recall FROM {gold} a LEFT JOIN (SELECT DISTINCT * FROM {got}) h ON h.query_id = a.query_id AND h.item = a.item GROUP BY a.query_id)"

SQL = {
    "built_prompts": f"WITH {_PROMPTS} SELECT * FROM pr",
    "prompt_metadata": f"""WITH {_PROMPTS}, rr AS (SELECT query_id, count(*) passages, round(avg(score), 6) mean_score FROM r GROUP BY query_id) SELECT query_id, passages, coalesce(n, 0) sentences, length(prompt)::INT letters, mean_score FROM pr JOIN rr USING (query_id) LEFT JOIN m USING (query_id)""",
    "passage_facts": f"WITH {_SEL} SELECT query_id, rank \"number\", string_agg(coalesce(title, '') || '::' || idx, '|' ORDER BY idx) facts FROM sel GROUP BY ALL",
    "stage_recalls": f"""WITH {_SEL}, asked AS (SELECT DISTINCT query_id FROM r), g AS (SELECT id query_id, unnest(supporting_facts) f FROM x),
gt AS (SELECT DISTINCT query_id, item FROM asked LEFT JOIN (SELECT query_id, f.title item FROM g WHERE f.title IS NOT NULL) USING (query_id)), gf AS (SELECT DISTINCT query_id, item FROM asked LEFT JOIN (SELECT query_id, f.title || '::' || f.sentence_index item FROM g WHERE f.title || '::' || f.sentence_index IS NOT NULL) USING (query_id)),
s1 AS (SELECT query_id, title item FROM j), s2 AS (SELECT query_id, title item FROM r),
s3 AS (SELECT sel.query_id, sel.title || '::' || (list_position(list_transform(r.sentences, lambda y: coalesce({Q.strip('y')} = sel.text OR starts_with({Q.strip('y')}, sel.text[1:50]), false)), true) - 1) item FROM sel JOIN r ON r.query_id = sel.query_id AND r.rank = sel.rank),
s4 AS (SELECT question_id query_id, f.title || '::' || f.sentence_index item FROM (SELECT question_id, unnest(sp) f FROM predictions))
{_RECALL('retrieval', 'gt', 's1')} UNION ALL {_RECALL('rerank', 'gt', 's2')} UNION ALL {_RECALL('sentence', 'gf', 's3')} UNION ALL {_RECALL('prediction', 'gf', 's4')}""",
    "rerank_topk": f"WITH {_RER} SELECT query_id, passage_idx, round(score, 6) score, rank FROM r",
    "sentence_select": f"WITH {_SEL} SELECT query_id, rank, idx::INT idx, round(sc, 4) score FROM sel",
    "facts_list": f"""WITH {_SEL}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY idx) k FROM sel QUALIFY k <= CASE WHEN rank < 2 THEN 3 ELSE 2 END), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) - 1 num FROM l)
SELECT query_id, 'AVAILABLE FACTS:' || chr(10) || string_agg('Fact ' || num || ': [' || coalesce(title, '') || ', ' || idx || '] ' || CASE WHEN length(text) > 180 THEN text[1:180] || '...' ELSE text END, chr(10) ORDER BY num) facts FROM n GROUP BY query_id""",
    "evidence_block": f"""WITH {_SEL}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY idx) k FROM sel QUALIFY k <= CASE WHEN rank < 2 THEN 3 ELSE 2 END),
n AS (SELECT query_id, rank, string_agg(chr(10) || '  [' || idx || '] ' || CASE WHEN length(text) > 180 THEN text[1:180] || '...' ELSE text END, '' ORDER BY idx) lines FROM l GROUP BY ALL)
SELECT query_id, 'Evidence:' || chr(10) || string_agg('Passage ' || rank || ': [' || coalesce(title, '') || ']' || coalesce(lines, ''), chr(10) ORDER BY rank) evidence FROM r LEFT JOIN n USING (query_id, rank) GROUP BY query_id""",
    "extract_claims": f"WITH p AS (SELECT pred_id, {Q.strip("coalesce(answer, '')")} a FROM predictions), c AS (SELECT pred_id, {_CLAIMS} c FROM p) SELECT pred_id, unnest(c) claim, (generate_subscripts(c, 1) - 1)::INT pos FROM c",
    "lexical_support": f"""WITH t AS (SELECT pred_id, {Q.verifier_terms("coalesce(answer, '')")} a, {Q.verifier_terms("coalesce(full_response, '')")} e FROM predictions), s AS (SELECT *, len(list_intersect(a, e)) k FROM t)
SELECT pred_id, round(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE least(1.0, 0.75::DOUBLE * k / len(a) + 0.25::DOUBLE * 2 * k / (len(a) + len(e))) END, 6) support FROM s""",
    "complexity_route": f"""WITH {_SEL}, p AS (SELECT query_id, any_value(question) question, max(score) FILTER (rank = 0) a, max(score) FILTER (rank = 1) b FROM r GROUP BY query_id), m AS (SELECT query_id, count(*) n FROM sel GROUP BY query_id),
z AS (SELECT query_id, greatest(0.0, least(1.0, 0.10::DOUBLE * (length(question) > 50)::INT + 0.35::DOUBLE * ({_KEYS})::INT + 0.20::DOUBLE * CASE WHEN b IS NULL THEN 0.5 ELSE 1 - greatest(0.0, least(1.0, (a - b) / (abs(a) + 1e-6))) END + 0.35::DOUBLE * (coalesce(n, 0) > 5)::INT)) c FROM p LEFT JOIN m USING (query_id))
SELECT query_id, round(c, 6) complexity, CASE WHEN c > 0.5 THEN 'complex' ELSE 'simple' END route FROM z""",
    "dedupe_facts": f"WITH {_DEDUP}, a AS (SELECT pred_id, string_agg(t || '::' || i, '|' ORDER BY pos) facts FROM f GROUP BY pred_id) SELECT pred_id, coalesce(facts, '') facts FROM predictions LEFT JOIN a USING (pred_id) WHERE sp IS NOT NULL",
    "decided_passages": f"""WITH {_EX}, {_DEDUP}, k AS (SELECT id question_id, unnest(contexts) c, generate_subscripts(contexts, 1) cp FROM x),
m AS (SELECT f.pred_id, f.pos, arg_min(coalesce(nullif(c.passage_id, ''), c.title), cp) passage_id FROM f JOIN k ON k.question_id = f.question_id AND k.c.title = f.t AND f.i >= 0 AND f.i < len(k.c.sentences) GROUP BY ALL) SELECT DISTINCT pred_id, passage_id FROM m WHERE passage_id <> ''""",
    "decide": f"""WITH r AS (SELECT run_name, query_id question_id, max(score) top FROM retrieval_results GROUP BY ALL), p AS (SELECT pred_id, {Q.strip("coalesce(answer, '')")} answer, verification.support_score s, coalesce(verification.is_supported, false) ok, coalesce(1 / (1 + exp(-top)), 0.0) k FROM predictions LEFT JOIN r USING (run_name, question_id))
SELECT pred_id, answer, round(round(CASE WHEN s IS NULL THEN k WHEN ok THEN 0.7::DOUBLE * s + 0.3::DOUBLE * k ELSE (0.7::DOUBLE * s + 0.3::DOUBLE * k) * 0.5 END, 4), 3) confidence, ok supported FROM p""",
    "resume_antijoin": "SELECT row_id, id FROM examples WHERE NOT EXISTS (SELECT 1 FROM predictions WHERE question_id = examples.id)",
    "gold_semijoin": "SELECT row_id, id FROM examples WHERE EXISTS (SELECT 1 FROM predictions WHERE question_id = examples.id)",
    "verify_claims": f"""WITH {_EX}, k0 AS (SELECT id question_id, unnest(contexts) c, generate_subscripts(contexts, 1) - 1 cp FROM x), k1 AS (SELECT question_id, cp, c.title title, unnest(c.sentences) s, generate_subscripts(c.sentences, 1) - 1 sp FROM k0 WHERE c.title IS NOT NULL),
ev AS (SELECT question_id, title, title || '::' || sp AS i, {Q.strip('s')} t, {Q.verifier_terms(Q.strip('s'))} et FROM k1 WHERE {Q.strip('s')} <> ''), {_DEDUP},
p AS (SELECT pred_id, question_id, {Q.strip("coalesce(answer, '')")} a, (SELECT count(*) FROM f WHERE f.pred_id = predictions.pred_id) nf FROM predictions WHERE question_id IN (SELECT question_id FROM ev)),
cl AS (SELECT pred_id, question_id, a, unnest(CASE WHEN len({_CLAIMS}) > 0 THEN {_CLAIMS} ELSE [a] END) c, unnest(range(1, 1 + greatest(1, len({_CLAIMS})))) cn FROM p WHERE a <> '' AND lower(a) NOT IN ('yes','no','noanswer')),
ct AS (SELECT *, {Q.verifier_terms('c')} ct FROM cl),
sc AS (SELECT pred_id, cn, max(CASE WHEN len(ct) = 0 OR len(et) = 0 OR len(list_intersect(ct, et)) = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE * len(list_intersect(ct, et)) / len(ct) + 0.25::DOUBLE * 2 * len(list_intersect(ct, et)) / (len(ct) + len(et)) END) s FROM ct JOIN ev USING (question_id) GROUP BY ALL),
ag AS (SELECT pred_id, avg(round(s, 4)) sup, avg((s >= 0.45)::INT) share, count(*) claims FROM sc GROUP BY pred_id),
yq AS (SELECT question_id, count(*) n, count(DISTINCT title) nt, sum(len(et)) toks, lower(string_agg(t, ' ')) txt FROM ev GROUP BY question_id),
yn AS (SELECT pred_id, least(1.0, CASE WHEN nf >= 2 AND n >= 2 THEN 0.65 WHEN nf >= 2 OR n >= 2 THEN 0.40 ELSE 0.15 END::DOUBLE + CASE WHEN nt >= 2 THEN 0.10 WHEN nt = 1 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN toks >= 15 THEN 0.10 WHEN toks >= 8 THEN 0.05 ELSE 0 END::DOUBLE
  + CASE WHEN {'{sig}'} >= 3 THEN 0.10 WHEN {'{sig}'} >= 1 THEN 0.05 ELSE 0 END::DOUBLE) s FROM p JOIN yq USING (question_id) WHERE lower(a) IN ('yes','no','noanswer')),
cv AS (SELECT pred_id, round(avg((e.i IS NOT NULL)::INT), 4) coverage FROM f LEFT JOIN (SELECT DISTINCT question_id, i FROM ev) e ON e.question_id = f.question_id AND e.i = f.t || '::' || f.i GROUP BY pred_id)
SELECT p.pred_id, round(round(coalesce(ag.sup, yn.s, 0), 4), 3) support_score, coalesce(CASE WHEN yn.s IS NOT NULL THEN round(yn.s, 4) >= 0.55 ELSE ag.sup >= 0.55 AND ag.share >= 1 END, false) is_supported, (CASE WHEN yn.s IS NOT NULL THEN 1 ELSE coalesce(ag.claims, 0) END)::INT claims, coverage FROM p LEFT JOIN ag USING (pred_id) LEFT JOIN yn USING (pred_id) LEFT JOIN cv USING (pred_id)""".replace("{sig}", "(" + " + ".join(f"contains(txt, '{w}')::INT" for w in "both also same different unlike whereas however but although while than more less not never neither nor".split()) + ")"),
}
