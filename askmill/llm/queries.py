"""Queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.llm import mixing, neardup, neighbours, packing, pairs, truncation
from askmill.llm.tokens import TOKENIZER, count_tokens
from askmill.plans.workspace import settle


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _p4(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(_table(spark, sf, "passages"), "passage_idx", neardup.passage_text(), t=0.7, least=20)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.expand_pairs(*_p4(spark, sf))
    return pairs.select(F.col("a").alias("passage_a"), F.col("b").alias("passage_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per passage: its class of equal word sets, its group of similar ones and the number of passages similar to it."""
    return neardup.groups(*_p4(spark, sf))


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, other, sim): the 5 most similar others of each vector."""
    return neighbours.nearest(_table(spark, sf, "dense_vectors"), "vec_id", "embedding", 64).withColumnRenamed("id", "vec_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(p5_nearest(spark, sf).withColumnRenamed("vec_id", "id"))
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    judged = truncation.judge(_table(spark, sf, "documents"), "doc_id", "text", "source")
    return judged.where("cut").select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts."""
    docs = _table(spark, sf, "documents")
    return truncation.rates(docs, truncation.judge(docs, "doc_id", "text", "source"), "source")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.inspect(_table(spark, sf, "predictions"))
    return found.where("defect IS NOT NULL").select(F.col("id").alias("pred_id"), "defect")


def p3_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Defects by run: (run_name, defect, pairs); sound pairs count under 'none'."""
    rows = _table(spark, sf, "predictions")
    found = pairs.inspect(rows).select(F.col("id").alias("pred_id"), F.coalesce("defect", F.lit("none")).alias("defect"))
    return rows.select("pred_id", "run_name").join(found, "pred_id").groupBy("run_name", "defect").agg(F.count("*").alias("pairs"))


def _limits(spark: SparkSession, sf: str) -> dict[int, int]:
    return {r.limit_id: r.capacity_tokens for r in _table(spark, sf, "pack_limits").collect()}  # the parameter table


def p6_placement(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document (of every piece of an oversized one) under each capacity."""
    placed, _ = packing.place(packing.sizes(_table(spark, sf, "documents"), "doc_id", "text", TOKENIZER), _limits(spark, sf))
    return placed.withColumnRenamed("id", "doc_id")


def p6_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and share of unused room of each capacity."""
    return packing.unused(p6_placement(spark, sf), _limits(spark, sf))


def _p7_chosen(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").where("doc_id IS NOT NULL")
    sized = count_tokens(docs.select(F.col("doc_id").alias("id"), "text", truncation.source_name(F.col("source")).alias("source")), keep=["source"])
    return mixing.choose(sized, _table(spark, sf, "mix_targets"))


def p7_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each mix with their repeat counts."""
    return _p7_chosen(spark, sf).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share each source of each mix really reached."""
    return mixing.shares(_p7_chosen(spark, sf), _table(spark, sf, "mix_targets"))


def p6_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the placing, by limit: every document once, none torn that fits, no container overfull."""
    limits = _limits(spark, sf)
    placed = settle(p6_placement(spark, sf), "placed")
    cap = F.create_map(*(x for k, c in limits.items() for x in (F.lit(k).cast("int"), F.lit(c).cast("int"))))[F.col("limit_id")]
    by = placed.groupBy("limit_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.max("piece").alias("last"), F.count_if(F.col("tokens") == cap).alias("full")).withColumn("cap", cap)
    docs = by.groupBy("limit_id").agg(F.count("*").alias("documents"), F.count_if((F.col("t") <= F.col("cap")) & (F.col("pieces") > 1)).alias("torn"), F.count_if((F.col("last") + 1 != F.col("pieces")) | (F.col("full") < F.col("pieces") - 1)).alias("odd_pieces"))
    loads = placed.groupBy("limit_id", "container").agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least")).withColumn("cap", cap)
    # no more than one container in a hundred, and one, above what the tokens need at the least
    all_ = loads.groupBy("limit_id").agg(F.count_if(F.col("t") > F.col("cap")).alias("overfull"), (F.count("*") <= F.ceil(F.sum("t") / F.first("cap")) * 1.01 + 1).alias("bounded"))
    return docs.join(all_, "limit_id").select("limit_id", "documents", "torn", "overfull", "odd_pieces", "bounded")


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mixes, by target: caps kept, only documents of the source, shares reached within a
    hundredth and the longest document.

    Where sources of a mix are missing, the shares of the others refer to what is there.
    """
    targets = _table(spark, sf, "mix_targets")
    chosen = settle(_p7_chosen(spark, sf), "chosen")
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), truncation.source_name(F.col("source")).alias("true_source"), F.coalesce(F.col("text") != "", F.lit(False)).alias("has_text"))
    t = targets.select("mix_name", truncation.source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = chosen.join(docs, "id", "left").join(t.select("mix_name", "source", "max_repeats"), ["mix_name", "source"])
    got = rows.groupBy("mix_name", "source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(~F.col("source").eqNullSafe(F.col("true_source"))).alias("strangers"), F.max("tokens").alias("longest"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    j = t.join(docs.where("true_source IS NOT NULL AND has_text").select(F.col("true_source").alias("source")).distinct().withColumn("present", F.lit(True)), "source", "left").join(got, ["mix_name", "source"], "left").fillna(0, ["over_cap", "strangers", "tokens", "longest"]).fillna(False, ["present"])
    w = Window.partitionBy("mix_name")
    wanted = F.when(F.col("present"), F.col("target_share")).otherwise(0.0)
    reached = F.abs(F.try_divide(F.col("tokens"), F.sum("tokens").over(w)) - wanted / F.sum(wanted).over(w)) <= 0.01 + F.try_divide(F.max("longest").over(w), F.sum("tokens").over(w))
    return j.select("mix_name", "source", "target_share", "present", "over_cap", "strangers", F.coalesce(reached, F.lit(False)).alias("on_target"))


QUERIES = {"p6_placement": p6_placement, "p6_unused": p6_unused, "p7_chosen": p7_chosen, "p7_shares": p7_shares, "p3_found": p3_found, "p3_by_run": p3_by_run, "p8_found": p8_found, "p8_rates": p8_rates, "p5_found": p5_found, "p5_nearest": p5_nearest, "p4_found": p4_found, "p4_groups": p4_groups, "p6_whole": p6_whole, "p7_kept": p7_kept}
_P4 = r"""w AS (SELECT passage_idx, list_distinct(regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(array_to_string(sentences, chr(10)), '')), '[\p{L}\p{N}]+')) ws FROM passages),
k AS (SELECT * FROM w WHERE len(ws) >= 20), u AS (SELECT passage_idx, len(ws) n, unnest(ws) x FROM k),
p AS (SELECT a.passage_idx passage_a, b.passage_idx passage_b, count(*) c, any_value(a.n) na, any_value(b.n) nb FROM u a JOIN u b ON a.x = b.x AND a.passage_idx < b.passage_idx GROUP BY ALL),
pairs AS (SELECT passage_a, passage_b FROM p WHERE c >= 0.7 * (na + nb - c))"""
_P7_DOCS = r"""d AS (SELECT doc_id, lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) source FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
t AS (SELECT mix_name, lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) source, target_share, max_repeats FROM mix_targets)"""
SQL = {
    "p4_found": f"WITH {_P4} SELECT passage_a, passage_b FROM pairs",
    "p4_groups": f"""WITH RECURSIVE {_P4}, both_ AS (SELECT passage_a a, passage_b b FROM pairs UNION ALL SELECT passage_b, passage_a FROM pairs),
reach(id, other) AS (SELECT passage_idx, passage_idx FROM k UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON e.a = r.other),
g AS (SELECT id, min(other) group_id FROM reach GROUP BY id), l AS (SELECT a, count(*) n FROM both_ GROUP BY a), c AS (SELECT passage_idx, min(passage_idx) OVER (PARTITION BY list_sort(ws)) cls FROM k)
SELECT id, cls, group_id, coalesce(n, 0) links FROM g JOIN c ON c.passage_idx = id LEFT JOIN l ON l.a = id""",
    "p6_whole": """WITH d AS (SELECT limit_id, doc_id FROM documents CROSS JOIN pack_limits WHERE doc_id IS NOT NULL AND capacity_tokens > 0)
SELECT limit_id, count(*) documents, 0::BIGINT torn, 0::BIGINT overfull, 0::BIGINT odd_pieces, true bounded FROM d GROUP BY limit_id""",
    "p7_kept": f"""WITH {_P7_DOCS}, s AS (SELECT DISTINCT source FROM d), m AS (SELECT mix_name, sum(target_share) FILTER (source IN (SELECT source FROM s)) there FROM t GROUP BY mix_name)
SELECT t.mix_name, t.source, target_share, t.source IN (SELECT source FROM s) present, 0::BIGINT over_cap, 0::BIGINT strangers, true on_target FROM t JOIN m USING (mix_name)""",
    "p5_found": """WITH v0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM dense_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) u FROM v0),
n AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) <= 5)
SELECT DISTINCT least(a, b) vec_a, greatest(a, b) vec_b FROM n""",
}
