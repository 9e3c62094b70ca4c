"""Queries over predictions and gold, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.functions import text as X
from askmill.operators import scoring as O
from askmill.plans import sqltext as Q


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _matched(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    return O.matched(_t(spark, sf, "predictions"), _t(spark, sf, "examples"), how)


def _over(f):
    return lambda spark, sf: f(O.analysed(_matched(spark, sf)))


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "predictions")
    return p.select("pred_id", X.normalize_official(F.col("answer")).alias("official"), X.normalize_custom(F.col("answer")).alias("custom"), F.size(X.claims(F.coalesce("answer", F.lit("")))).alias("claims"))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "predictions").select("pred_id", X.normalize_generated(F.col("answer")).alias("answer"))


def yesno_question(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "examples").select("row_id", X.is_yesno_question(F.coalesce("question", F.lit(""))).alias("yesno"))


def numeric_answer(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "predictions")
    c = lambda n: F.coalesce(n, F.lit(""))
    return p.select("pred_id", X.numeric_answer(c("answer"), c("question"), c("full_response")).alias("answer"))


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    return O.official_rows(_matched(spark, sf)).select("pred_id", *(F.round(k, 6).alias(k) for k in O.METRICS))


QUERIES = {
    "official_metrics": lambda s, sf: O.official_metrics(_matched(s, sf)),
    "answer_scores": answer_scores,
    "custom_metrics": lambda s, sf: O.custom_metrics(_matched(s, sf, "left")),
    "error_classes": _over(O.error_classes),
    "metrics_by_type": _over(lambda a: O.breakdown(a, "type")),
    "metrics_by_level": _over(lambda a: O.breakdown(a, "level")),
    "fact_errors": _over(O.fact_errors),
    "yesno_entity_breakdown": _over(O.yesno_entity),
    "verification_breakdown": _over(O.verification_report),
    "verification_by_type": _over(lambda a: O.verification_report(a, "type")),
    "worst_answers": _over(O.worst_answers),
    "false_negatives": _over(O.false_negatives),
    "fuzzy_metrics": lambda s, sf: O.fuzzy_metrics(_matched(s, sf, "left")),
    "run_counts": lambda s, sf: O.run_counts(_t(s, sf, "predictions")),
    "normalized_answers": normalized,
    "normalize_generated": generated,
    "yesno_question": yesno_question,
    "numeric_answer": numeric_answer,
}

_PAIRS = "coalesce(list_transform(list_filter({0}, lambda f: f IS NOT NULL), lambda f: {{'t': f.title, 'i': f.sentence_index}}), [])"
_MATCHED = f"""
g0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) rn FROM examples),
g AS (SELECT id question_id, coalesce(answer, '') gold, coalesce(question_type, '') AS "type", coalesce(question_level, '') AS "level", {_PAIRS.format('supporting_facts')} gold_sp FROM g0 WHERE rn = 1),
p0 AS (SELECT *, row_number() OVER (PARTITION BY run_name, question_id ORDER BY pred_id DESC) rn FROM predictions),
p AS (SELECT pred_id, run_name, question_id, gold_answer, coalesce(answer, '') answer, {_PAIRS.format('sp')} sp, verification FROM p0 WHERE rn = 1)"""
_SCORED = f"""WITH {_MATCHED},
m AS (SELECT p.*, g.gold, g."type", g."level", g.gold_sp, {Q.official_words('p.answer')} pw, {Q.official_words('g.gold')} gw FROM p JOIN g USING (question_id)),
n AS (SELECT *, {Q.joined('pw')} pn, {Q.joined('gw')} gn, list_distinct(sp) ps, list_distinct(gold_sp) gs FROM m),
c AS (SELECT *, {Q.common('pw', 'gw')} plain_same, len(list_filter(ps, lambda f: list_contains(gs, f))) tp FROM n),
d AS (SELECT *, CASE WHEN (pn IN ('yes','no','noanswer') OR gn IN ('yes','no','noanswer')) AND pn <> gn THEN 0 ELSE plain_same END same FROM c),
e AS (SELECT *, (pn = gn)::INT::DOUBLE em, {Q.ratio('same', 'len(pw)')} prec, {Q.ratio('same', 'len(gw)')} recall,
  (tp = len(ps) AND tp = len(gs))::INT::DOUBLE sp_em, {Q.ratio('tp', 'len(ps)')} sp_prec, {Q.ratio('tp', 'len(gs)')} sp_recall, {Q.ratio('plain_same', 'len(pw)')} pp, {Q.ratio('plain_same', 'len(gw)')} pr FROM d),
s AS (SELECT *, {Q.f_measure('prec', 'recall')} f1, {Q.f_measure('sp_prec', 'sp_recall')} sp_f1, em * sp_em joint_em, prec * sp_prec joint_prec, recall * sp_recall joint_recall, {Q.f_measure('pp', 'pr')} plain_f1 FROM e),
j AS (SELECT *, {Q.f_measure('joint_prec', 'joint_recall')} joint_f1, lower(gold) IN ('yes','no') yn, {Q.strip('lower(answer)')} low FROM s),
a AS (SELECT *, low IN ('yes','no') said, CASE WHEN em = 1 THEN 'correct' WHEN low IN ('cannot answer based on the provided evidence.', 'cannot determine from evidence', '') THEN 'abstained'
  WHEN yn AND low NOT IN ('yes','no') THEN 'yesno_wrong' WHEN NOT yn AND low IN ('yes','no') THEN 'wrong_type' WHEN plain_f1 > 0.5 THEN 'partial'
  WHEN len({Q.words(Q.strip('answer'))}) > 10 THEN 'too_long' ELSE 'wrong' END error FROM j)
"""
_AVG = ", ".join(f"round(avg({k}), 6) {k}" for k in O.METRICS)
_FAILED = "('Error occurred during processing.', 'Cannot answer based on the provided evidence.', '')"
_VER = """SELECT run_name, {0} count(*) FILTER (verification IS NULL) skipped, count(*) FILTER (verification.is_supported) supported, count(*) FILTER (NOT verification.is_supported) unsupported,
 round(avg(verification.support_score), 9) avg_support, round(min(verification.support_score), 6) min_support, round(max(verification.support_score), 6) max_support,
 round(avg(em) FILTER (verification.is_supported), 6) em_supported, round(avg(em) FILTER (NOT verification.is_supported), 6) em_unsupported,
 round(round(avg(em) FILTER (verification.is_supported), 6) - round(avg(em) FILTER (NOT verification.is_supported), 6), 6) em_gap FROM a GROUP BY ALL"""
_C_MARKS = r"""regexp_replace({0}, '[!-/:-@\[-`{{-~]', '', 'g')"""
_ASCII_ART = r"""regexp_replace(lower({0}), '(^|[^\w\x{{80}}-\x{{10FFFF}}])(a|an|the)($|[^\w\x{{80}}-\x{{10FFFF}}])', '\1 \3', 'g')"""


def _custom(x: str) -> str:
    """Articles first: applied twice, as neighbours share a boundary."""
    once = _ASCII_ART.format(x)
    return Q.words(Q.strip(_C_MARKS.format(_ASCII_ART.format(once))))


_TITLES = "list_distinct(list_transform({0}, lambda f: coalesce(f.t, chr(1))))"
_SUB = "len({0}) > 0 AND len({1}) > 0 AND (len(list_filter({0}, lambda f: NOT list_contains({1}, f))) = 0 OR len(list_filter({1}, lambda f: NOT list_contains({0}, f))) = 0)"
_EQ = "len(list_filter({0}, lambda f: NOT list_contains({1}, f))) = 0 AND len(list_filter({1}, lambda f: NOT list_contains({0}, f))) = 0"
_SETF1 = "CASE WHEN len(list_intersect({0}, {1})) > 0 THEN 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) ELSE 0.0 END"
_CUSTOM = f"""WITH {_MATCHED},
m AS (SELECT p.*, g.gold, g.gold_sp, coalesce(nullif(p.gold_answer, ''), g.gold, '') own, p.answer NOT IN {_FAILED} ok FROM p LEFT JOIN g USING (question_id)),
w AS (SELECT *, {_custom('answer')} aw, {_custom('own')} ow, list_distinct(sp) ps, list_distinct(gold_sp) gs, {_TITLES.format('sp')} pt, {_TITLES.format('gold_sp')} gt, gold IS NOT NULL AND ok has FROM m),
n AS (SELECT *, {Q.joined('aw')} na, {Q.joined('ow')} ng, len(list_intersect(list_distinct(aw), list_distinct(ow))) same FROM w),
f AS (SELECT *, {Q.ratio('same', 'len(aw)')} p_, {Q.ratio('same', 'len(ow)')} r_ FROM n)
SELECT run_name, count(*) total, count(*) FILTER (ok) valid, count(*) FILTER (NOT ok) failed,
 round(avg((na = ng)::INT) FILTER (ok), 6) em_valid, round(avg({Q.f_measure('p_', 'r_')}) FILTER (ok), 6) f1_valid, round(avg((na <> '' AND ng <> '' AND (contains(ng, na) OR contains(na, ng)))::INT) FILTER (ok), 6) containment_valid,
 round(avg(({_EQ.format('ps', 'gs')})::INT) FILTER (has), 6) sp_em_set, round(avg({_SETF1.format('ps', 'gs')}) FILTER (has), 6) sp_f1_set, round(avg(({_SUB.format('ps', 'gs')})::INT) FILTER (has), 6) sp_containment,
 round(avg(({_EQ.format('pt', 'gt')})::INT) FILTER (has), 6) title_em, round(avg({_SETF1.format('pt', 'gt')}) FILTER (has), 6) title_f1, round(avg(({_SUB.format('pt', 'gt')})::INT) FILTER (has), 6) title_containment
FROM f GROUP BY run_name"""

_SPAN = lambda x: f"len({Q.words(x)}) <= 5"
_g = Q.strip("answer")
for _mark in ('"', "''"):
    _g = f"regexp_replace({_g}, '^{_mark}+|{_mark}+$', '', 'g')"
_g = Q.strip(rf"regexp_replace({Q.strip(_g)}, '\s*\([^)]*\)\s*$', '')")
for _pattern in X.PREAMBLES:
    _g = f"regexp_replace({_g}, '{_pattern}', '', 'i')"
_GENERATED = rf"""WITH a AS (SELECT pred_id, {_g} a FROM predictions), b AS (SELECT pred_id, CASE WHEN {_SPAN('a')} THEN regexp_replace(a, '^(?:the|a|an)\s+', '', 'i') ELSE a END b FROM a),
c AS (SELECT pred_id, CASE WHEN {_SPAN('b')} AND b LIKE '%.' THEN {Q.strip("regexp_replace(b, '[.]$', '')")} ELSE b END c FROM b), d AS (SELECT pred_id, CASE WHEN {_SPAN('c')} THEN regexp_replace(c, '[.,;:!?]+$', '') ELSE c END d FROM c)
SELECT pred_id, {Q.strip(f"CASE WHEN {Q.strip('lower(d)')} IN ('yes', 'no', 'noanswer') THEN {Q.strip('lower(d)')} ELSE d END")} answer FROM d"""

SQL = {
    "normalize_generated": _GENERATED,
    "official_metrics": f"{_SCORED} SELECT run_name, count(*) n, {_AVG} FROM a GROUP BY run_name",
    "answer_scores": f"{_SCORED} SELECT pred_id, {', '.join(f'round({k}, 6) {k}' for k in O.METRICS)} FROM a",
    "custom_metrics": _CUSTOM,
    "error_classes": f"{_SCORED} SELECT run_name, error, count(*) n FROM a GROUP BY ALL",
    "metrics_by_type": f'{_SCORED} SELECT run_name, "type", count(*) n, round(avg(em), 6) em_rate, round(avg(plain_f1), 6) avg_f1 FROM a GROUP BY ALL',
    "metrics_by_level": f'{_SCORED} SELECT run_name, "level", count(*) n, round(avg(em), 6) em_rate, round(avg(plain_f1), 6) avg_f1 FROM a GROUP BY ALL',
    "fact_errors": f"""{_SCORED}, t AS (SELECT *, list_transform(sp, lambda f: coalesce(f.t, chr(1))) pt, {_EQ.format('ps', 'gs')} eq, len(sp) > 0 given FROM a)
SELECT run_name, count(*) FILTER (eq) sp_correct, count(*) FILTER (NOT given) sp_empty, count(*) FILTER (given AND len(sp) < len(gold_sp)) too_few, count(*) FILTER (given AND len(sp) > len(gold_sp)) too_many,
 sum(CASE WHEN given AND NOT eq THEN len(list_filter(gold_sp, lambda f: list_contains(pt, coalesce(f.t, chr(1))) AND NOT list_contains(ps, f))) ELSE 0 END)::BIGINT wrong_index_facts,
 count(*) FILTER (given AND len(list_filter(gold_sp, lambda f: NOT list_contains(pt, coalesce(f.t, chr(1))))) > 0) missing_title, round(avg(len(sp)), 6) avg_pred, round(avg(len(gold_sp)), 6) avg_gold FROM t GROUP BY run_name""",
    "yesno_entity_breakdown": f"""{_SCORED} SELECT run_name, count(*) FILTER (yn) yesno, count(*) FILTER (yn AND em = 1) yesno_correct, count(*) FILTER (yn AND em = 0 AND said) yesno_wrong, count(*) FILTER (yn AND em = 0 AND NOT said) yesno_other,
 count(*) FILTER (NOT yn) entity, count(*) FILTER (NOT yn AND em = 1) entity_correct, count(*) FILTER (NOT yn AND em = 0 AND plain_f1 > 0.5) entity_partial, count(*) FILTER (NOT yn AND em = 0 AND plain_f1 <= 0.5) entity_wrong FROM a GROUP BY run_name""",
    "verification_breakdown": f"{_SCORED} {_VER.format('')}",
    "verification_by_type": f"{_SCORED} {_VER.format(chr(34) + 'type' + chr(34) + ',')}",
    "worst_answers": f"{_SCORED}, w AS (SELECT run_name, pred_id, question_id, round(plain_f1, 3) f1, error FROM a WHERE em = 0) SELECT *, (row_number() OVER (PARTITION BY run_name ORDER BY f1, pred_id))::INT place FROM w QUALIFY place <= 15",
    "false_negatives": f"{_SCORED}, w AS (SELECT run_name, pred_id, verification.support_score support_score FROM a WHERE em = 1 AND NOT verification.is_supported) SELECT *, (row_number() OVER (PARTITION BY run_name ORDER BY support_score NULLS LAST, pred_id))::INT place FROM w QUALIFY place <= 5",
    "run_counts": f"SELECT run_name, count(*) AS \"rows\", count(*) FILTER ({Q.strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')} = '') empty, count(*) FILTER (coalesce(answer, '') IN {_FAILED}) failed, count(*) FILTER ({Q.strip('lower(coalesce(answer, ' + chr(39) * 2 + '))')} IN ('cannot answer based on the provided evidence.', 'cannot determine from evidence', '')) abstained FROM predictions GROUP BY run_name",
    "normalized_answers": f"SELECT pred_id, CASE WHEN answer IS NULL THEN NULL ELSE {Q.official('answer')} END official, CASE WHEN answer IS NULL THEN NULL ELSE {Q.joined(_custom('answer'))} END custom, least(6, len(list_filter(list_transform(string_split_regex(regexp_replace({Q.joined(Q.words(Q.strip('coalesce(answer, ' + chr(39) * 2 + ')')))}, '([.?!;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda c: trim(c, ' -')), lambda c: c <> '')))::INT claims FROM predictions",
    "yesno_question": f"WITH q AS (SELECT row_id, lower({Q.strip('coalesce(question, ' + chr(39) * 2 + ')')}) q FROM examples) SELECT row_id, NOT regexp_matches(q, '^({X.ENTITY_STARTS})') AND regexp_matches(q, '^({X.YESNO_STARTS})') yesno FROM q",
    "numeric_answer": f"""WITH b AS (SELECT pred_id, coalesce(answer, '') a, lower(coalesce(question, '')) q, coalesce(full_response, '') e FROM predictions),
n AS (SELECT *, {' OR '.join(f"contains(q, '{t}')" for t in X.NUMERIC_TRIGGERS)} asks, {', '.join(f"regexp_extract_all(e, '{p}', 1) c{i}" for i, p in enumerate(X.NUMERIC_CONTEXTS))}, regexp_extract_all(e, '\\b(\\d[\\d,]+)\\b', 1) nums FROM b)
SELECT pred_id, CASE WHEN asks AND NOT regexp_matches(a, '\\d') THEN coalesce(c0[1], c1[1], c2[1], list_filter(nums, lambda x: NOT suffix(x, '00'))[1], nums[1], a) ELSE a END answer FROM n""",
}
