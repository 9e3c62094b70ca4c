"""Scorers of predictions against gold: official, custom, error analysis and verification reports.

Gold and predictions meet by one equi-join on the question id; everything after it is an expression of one
row and one partial-and-final aggregation by run.  Where an id repeats, the last row wins (greatest row
number), as a keyed object would keep it.  NULL answers count as empty, NULL facts as none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.functions import scores as S
from askmill.functions import text as X
from askmill.operators.retrieval import token_set_ratio
from askmill.plans.workspace import settle

#: Answers that mean a failed run, and those that mean an abstention (compared in lower case).
FAILED = ["Error occurred during processing.", "Cannot answer based on the provided evidence.", ""]
ABSTAINED = ["cannot answer based on the provided evidence.", "cannot determine from evidence", ""]


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; max_by combines before the shuffle, so a hot key costs little."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return kept.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def _pairs(facts: Column) -> Column:
    """Facts as comparable pairs; NULL elements are dropped."""
    return F.transform(F.filter(F.coalesce(facts, F.array().cast("array<struct<title:string,sentence_index:int>>")), lambda f: f.isNotNull()), lambda f: F.struct(f["title"].alias("t"), f["sentence_index"].alias("i")))


def matched(predictions: DataFrame, examples: DataFrame, how: str = "inner") -> DataFrame:
    """Last prediction of each run and question with its gold."""
    gold = last_by(examples.select("row_id", F.col("id").alias("question_id"), F.col("answer").alias("gold"), F.col("question_type").alias("type"), F.col("question_level").alias("level"), F.col("supporting_facts").alias("gold_sp")), ["question_id"], "row_id")
    gold = gold.withColumns({"gold": F.coalesce("gold", F.lit("")), "gold_sp": _pairs(F.col("gold_sp")), "type": F.coalesce("type", F.lit("")), "level": F.coalesce("level", F.lit(""))})
    pred = last_by(predictions.select("pred_id", "run_name", "question_id", "question", "gold_answer", "answer", "sp", "verification"), ["run_name", "question_id"], "pred_id")
    pred = pred.withColumns({"answer": F.coalesce("answer", F.lit("")), "sp": _pairs(F.col("sp"))})
    return pred.join(gold.drop("row_id"), "question_id", how)


def official_rows(m: DataFrame) -> DataFrame:
    """The twelve official values of each matched prediction."""
    s = m.withColumns({"a": S.answer_score(F.col("answer"), F.col("gold")), "f": S.fact_score(F.col("sp"), F.col("gold_sp"))})
    jp, jr = F.col("a.prec") * F.col("f.prec"), F.col("a.recall") * F.col("f.recall")
    joint = {"joint_em": F.col("a.em") * F.col("f.em"), "joint_f1": S.f_measure(jp, jr), "joint_prec": jp, "joint_recall": jr}
    return s.select("run_name", "question_id", "pred_id", "type", "level", *(F.col(f"a.{k}").alias(k) for k in ("em", "f1", "prec", "recall")), *(F.col(f"f.{k}").alias(f"sp_{k}") for k in ("em", "f1", "prec", "recall")), *(v.alias(k) for k, v in joint.items()))


METRICS = [p + k for p in ("", "sp_", "joint_") for k in ("em", "f1", "prec", "recall")]


def official_metrics(m: DataFrame, by: str = "run_name") -> DataFrame:
    return official_rows(m).groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(k), 6).alias(k) for k in METRICS))


def custom_metrics(m: DataFrame) -> DataFrame:
    """Custom scorer by run (``m``: left-matched); support metrics over predictions that have gold."""
    own = F.coalesce(F.nullif("gold_answer", F.lit("")), "gold", F.lit(""))
    ok = ~F.col("answer").isin(FAILED)
    a, g = X.normalize_custom(F.col("answer")), X.normalize_custom(F.col("own"))
    titles = lambda c: F.array_distinct(F.transform(c, lambda f: f["t"]))
    subset = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    m = m.withColumn("own", own).withColumns({"na": a, "ng": g, "ok": ok, "ps": F.array_distinct("sp"), "gs": F.array_distinct("gold_sp"), "pt": titles(F.col("sp")), "gt": titles(F.col("gold_sp")), "has": F.col("gold").isNotNull() & ok})
    equal = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    rate = lambda c, when: F.round(F.avg(F.when(F.col(when), c.cast("double"))), 6)
    inside = (F.col("na") != "") & (F.col("ng") != "") & (F.contains("ng", "na") | F.contains("na", "ng"))
    return m.groupBy("run_name").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("failed"),
        rate(F.col("na") == F.col("ng"), "ok").alias("em_valid"), rate(S.custom_f1(F.col("answer"), F.col("own")), "ok").alias("f1_valid"), rate(inside, "ok").alias("containment_valid"),
        rate(equal(F.col("ps"), F.col("gs")), "has").alias("sp_em_set"), rate(S.set_f1(F.col("ps"), F.col("gs")), "has").alias("sp_f1_set"), rate(subset(F.col("ps"), F.col("gs")), "has").alias("sp_containment"),
        rate(equal(F.col("pt"), F.col("gt")), "has").alias("title_em"), rate(S.set_f1(F.col("pt"), F.col("gt")), "has").alias("title_f1"), rate(subset(F.col("pt"), F.col("gt")), "has").alias("title_containment"),
    )


def analysed(m: DataFrame) -> DataFrame:
    """Each matched prediction with its plain F1, exact match and error class."""
    low, gold_low = X.strip(F.lower("answer")), F.lower("gold")
    em = X.normalize_official(F.col("answer")) == X.normalize_official(F.col("gold"))
    m = m.withColumns({"f1": S.plain_f1(F.col("answer"), F.col("gold")), "em": em, "yn": gold_low.isin("yes", "no"), "said_yn": low.isin("yes", "no")})
    error = (
        F.when(F.col("em"), "correct")
        .when(low.isin(ABSTAINED), "abstained")
        .when(F.col("yn") & ~F.col("said_yn"), "yesno_wrong")
        .when(~F.col("yn") & F.col("said_yn"), "wrong_type")
        .when(F.col("f1") > 0.5, "partial")
        .when(F.size(X.words(F.col("answer"))) > 10, "too_long")
        .otherwise("wrong")
    )
    return m.withColumn("error", error)


def error_classes(a: DataFrame) -> DataFrame:
    return a.groupBy("run_name", "error").agg(F.count("*").alias("n"))


def breakdown(a: DataFrame, by: str) -> DataFrame:
    return a.groupBy("run_name", by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("em").cast("double")), 6).alias("em_rate"), F.round(F.avg("f1"), 6).alias("avg_f1"))


def fact_errors(a: DataFrame) -> DataFrame:
    p, g = F.array_distinct("sp"), F.array_distinct("gold_sp")
    name = lambda f: F.coalesce(f["t"], F.lit("\x01"))  # noqa: E731  (two missing titles are the same)
    pt = F.transform("sp", name)
    equal = (F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)
    some = F.size("sp") > 0
    near = F.size(F.filter("gold_sp", lambda f: F.array_contains(pt, name(f)) & ~F.array_contains(p, f)))
    missing = F.size(F.filter("gold_sp", lambda f: ~F.array_contains(pt, name(f)))) > 0
    count = lambda c: F.count_if(c)
    return a.groupBy("run_name").agg(count(equal).alias("sp_correct"), count(~some).alias("sp_empty"), count(some & (F.size("sp") < F.size("gold_sp"))).alias("too_few"), count(some & (F.size("sp") > F.size("gold_sp"))).alias("too_many"), F.sum(F.when(some & ~equal, near).otherwise(0)).alias("wrong_index_facts"), count(some & missing).alias("missing_title"), F.round(F.avg(F.size("sp")), 6).alias("avg_pred"), F.round(F.avg(F.size("gold_sp")), 6).alias("avg_gold"))


def yesno_entity(a: DataFrame) -> DataFrame:
    yn, em, said = F.col("yn"), F.col("em"), F.col("said_yn")
    return a.groupBy("run_name").agg(F.count_if(yn).alias("yesno"), F.count_if(yn & em).alias("yesno_correct"), F.count_if(yn & ~em & said).alias("yesno_wrong"), F.count_if(yn & ~em & ~said).alias("yesno_other"), F.count_if(~yn).alias("entity"), F.count_if(~yn & em).alias("entity_correct"), F.count_if(~yn & ~em & (F.col("f1") > 0.5)).alias("entity_partial"), F.count_if(~yn & ~em & (F.col("f1") <= 0.5)).alias("entity_wrong"))


def verification_report(a: DataFrame, *by: str) -> DataFrame:
    """Support scores and exact match by run (and more); predictions without a check are skipped."""
    v, em = F.col("verification"), F.col("em").cast("double")
    rate = lambda ok: F.round(F.avg(F.when(v["is_supported"] == ok, em)), 6)
    r6 = lambda c: F.round(c, 6)
    return a.groupBy("run_name", *by).agg(F.count_if(v.isNull()).alias("skipped"), F.count_if(v["is_supported"]).alias("supported"), F.count_if(~v["is_supported"]).alias("unsupported"), F.round(F.avg(v["support_score"]), 9).alias("avg_support"), r6(F.min(v["support_score"])).alias("min_support"), r6(F.max(v["support_score"])).alias("max_support"), rate(True).alias("em_supported"), rate(False).alias("em_unsupported"), r6(rate(True) - rate(False)).alias("em_gap"))


def worst_answers(a: DataFrame, k: int = 15) -> DataFrame:
    """The k wrong answers of each run with the least F1 (three places), first predictions first."""
    rows = a.where(~F.col("em")).select("run_name", "pred_id", "question_id", F.round("f1", 3).alias("f1"), "error")
    w = Window.partitionBy("run_name").orderBy("f1", "pred_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def false_negatives(a: DataFrame, k: int = 5) -> DataFrame:
    """The k right answers of each run that the check scored least though it called them unsupported."""
    rows = a.where(F.col("em") & ~F.col("verification.is_supported")).select("run_name", "pred_id", F.col("verification.support_score").alias("support_score"))
    w = Window.partitionBy("run_name").orderBy(F.asc_nulls_last("support_score"), "pred_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def run_counts(predictions: DataFrame) -> DataFrame:
    a = F.coalesce("answer", F.lit(""))
    return predictions.groupBy("run_name").agg(F.count("*").alias("rows"), F.count_if(X.strip(a) == "").alias("empty"), F.count_if(a.isin(FAILED)).alias("failed"), F.count_if(X.strip(F.lower(a)).isin(ABSTAINED)).alias("abstained"))


def fuzzy_metrics(m: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Token-set similarity of answers by run: mean, near misses and misses; and of titles, the best for each gold title.

    The similarity has no built-in form; a pandas function computes it batch by batch.
    """
    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    own = F.coalesce(F.nullif("gold_answer", F.lit("")), "gold", F.lit(""))
    ok = m.where(~F.col("answer").isin(FAILED)).withColumn("own", own)
    ok = ok.withColumns({"s": similar(F.lower("answer"), F.lower("own")), "em": X.normalize_custom(F.col("answer")) == X.normalize_custom(F.col("own"))})
    answers = ok.groupBy("run_name").agg(F.round(F.avg(F.col("s") / 100), 6).alias("fuzzy_valid"), F.count_if(~F.col("em") & (F.col("s") >= threshold)).alias("close"), F.count_if(~F.col("em") & (F.col("s") < threshold)).alias("wrong"))
    @F.pandas_udf("double")
    def similar_sets(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(max(token_set_ratio(x, y) for y in ys) for x in xs) / len(xs) if len(xs) and len(ys) else 0.0 for xs, ys in zip(a, b)], dtype="float64")

    titles = lambda c: F.array_distinct(F.transform(F.filter(c, lambda f: f["t"].isNotNull()), lambda f: F.lower(f["t"])))
    # written first: Spark doesn't evaluate a Python function over higher-order functions
    sets = settle(ok.where("gold IS NOT NULL").select("run_name", titles(F.col("gold_sp")).alias("g"), titles(F.col("sp")).alias("p")), "titles")
    pairs = sets.select("run_name", similar_sets("g", "p").alias("s"))
    return answers.join(pairs.groupBy("run_name").agg(F.round(F.avg(F.col("s") / 100), 6).alias("title_fuzzy")), "run_name", "left")


def model_similarity(m: DataFrame, scorer) -> DataFrame:
    """Means of a model's precision, recall and F (``scorer(answer, gold)``: STRUCT(p, r, f), or one number for F) by run, and
    the shares of all rows with an F at or above three marks; failed answers count as rows without F."""
    bad = F.col("answer").isin(FAILED)
    s = settle(m.withColumn("s", scorer(F.col("answer"), F.coalesce(F.nullif("gold_answer", F.lit("")), "gold", F.lit("")))).withColumn("bad", bad), "similar")
    parts = {"p": "s.p", "r": "s.r", "f": "s.f"} if dict(s.dtypes)["s"].startswith("struct") else {"f": "s"}
    s = s.withColumns({k: F.when(~F.col("bad"), F.col(c)) for k, c in parts.items()})
    means = (F.round(F.avg(k), 6).alias({"p": "precision", "r": "recall", "f": "mean"}[k]) for k in parts)
    return s.groupBy("run_name").agg(*means, *(F.round(F.avg(F.coalesce((F.col("f") >= x).cast("double"), F.lit(0.0))), 6).alias(f"ge{int(x * 100)}") for x in (0.9, 0.85, 0.8)))


def evaluate(predictions: DataFrame, examples: DataFrame, save_to: str | None = None) -> DataFrame:
    """The official metrics by run; raises ValueError where no prediction meets a gold question."""
    found = official_metrics(matched(predictions, examples))
    if found.isEmpty():
        raise ValueError("no prediction has a gold question")
    if save_to:
        from askmill.sources.store import save_metrics

        save_metrics(found, save_to)
    return found


def recall_of(stage: str, gold: DataFrame, got: DataFrame, key: str = "query_id", item: str = "item") -> DataFrame:
    """(stage, questions, mean_recall, perfect, zero): how much of each question's gold items a stage still has.

    ``gold`` has every question, with a NULL item where it has none: its recall is 0.
    """
    hits = gold.select(key, item).distinct().join(got.select(key, item).distinct().withColumn("hit", F.lit(1)), [key, item], "left")
    per = hits.groupBy(key).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if(F.col("recall") >= 1).alias("perfect"), F.count_if(F.col("recall") <= 0).alias("zero")).select(F.lit(stage).alias("stage"), "questions", "mean_recall", "perfect", "zero")
