"""Mixing sources to target shares of all tokens, by Pareto order sampling.

A mix is made as large as its shares allow: the largest total at which no source must use a document more
than ``max_repeats`` times.  A source gives ``share * total`` tokens.  Its documents expect copies in
proportion to their size (probability proportional to size), never above ``max_repeats``; where the cap binds,
the others take over what is missing.  The whole part of the expectation is allocated for certain.  The
fraction f is drawn by Pareto order sampling: documents are ranked by (u / (1-u)) / (f / (1-f)) with u from a
hash of mix and id, and taken in that order until the source has its tokens.

The plan is made from size classes (1 % wide) with their sums of sizes and squares, so what comes to the driver is
bounded by the targets; what a class at the cap leaves inexact, the cut makes good.

No source is sorted in one task: ranks fall into BUCKETS buckets per source and each of these into BUCKETS finer
ones.  Token sums are added up first; in the bucket in which the source reaches its tokens the finer ones are summed, and
only the rows of one finer bucket (a BUCKETS**2-th of the range) are ordered one by one.

Defined cases: documents with NULL, empty text or NULL source, and sources no mix names, are never chosen; a
source without documents contributes 0 and the shares of the others refer to the total of the mix, so it
is reported as missed; targets with a NULL or non-positive share or ``max_repeats`` contribute 0; repeated
rows are documents of their own; ids must be unique.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.truncation import source_name
from askmill.plans.workspace import settle

BUCKETS = 4096
#: Log-odds ratios are bucketed from -SPREAD to SPREAD.
SPREAD = 64.0
CLASS = 1.01
SEED = 11


def expected(need: float, cap: int, top: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> float:
    """Copies per token c such that the sum of size * min(cap, c * size) is ``need``; infinite if all are capped.

    Size classes have their greatest size, the sum of sizes and the sum of squares.
    """
    order = np.argsort(-top)
    top, s1, s2 = (x[order].astype(float) for x in (top, s1, s2))
    capped, rest = 0.0, float(s2.sum())
    for t, a, b in zip(top, s1, s2):
        c = (need - capped) / rest if rest > 1e-9 else np.inf
        if c * t <= cap * (1 + 1e-12):
            return c
        capped += cap * a
        rest -= b
    return np.inf


def allocate(by_size: DataFrame, targets: DataFrame) -> list[tuple]:
    """[(mix, source, share, cap, c, need)]: what each source of each mix must give."""
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").toPandas()  # the parameter table
    names = [x for x in wanted["source"].dropna().unique().tolist()]
    sizes = by_size.where(F.col("source").isin(names)).toPandas()  # a row per named source and size class
    have = {s: (g["top"].to_numpy(), g["s1"].to_numpy(float), g["s2"].to_numpy(float)) for s, g in sizes.groupby("source")}
    out = []
    for mix, rows in wanted.groupby("mix_name"):
        rows = rows[(rows["target_share"] > 0) & (rows["max_repeats"] > 0)]
        totals = [r.max_repeats * float(have[r.source][1].sum()) / r.target_share for r in rows.itertuples() if r.source in have]
        total = min(totals, default=0.0)
        for r in rows.itertuples():
            if r.source in have:
                need = r.target_share * total
                out.append((mix, r.source, float(r.target_share), int(r.max_repeats), float(expected(need, int(r.max_repeats), *have[r.source])), need))
    return out


def choose(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, id, source, tokens, copies) of the chosen documents; ``docs``: (id, source, tokens)."""
    spark = docs.sparkSession
    docs = settle(docs.where(F.col("source").isNotNull() & (F.col("tokens") > 0)), "mix-docs")
    size = F.floor(F.log("tokens") / float(np.log(CLASS)))
    by_size = docs.groupBy("source", size.alias("class")).agg(F.max("tokens").alias("top"), F.sum("tokens").alias("s1"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("s2"))
    plan = allocate(by_size, targets)
    # as many rows as targets: a parameter table
    plan = spark.createDataFrame(plan, "mix_name string, source string, share double, cap int, c double, need double")
    e = F.least(F.col("cap").cast("double"), F.when(F.col("c") == float("inf"), F.col("cap").cast("double")).otherwise(F.col("c") * F.col("tokens")))
    rows = docs.join(F.broadcast(plan), "source").withColumn("e", e).withColumn("sure", F.floor(F.col("e") + 1e-9).cast("int"))
    f = F.greatest(F.col("e") - F.col("sure"), F.lit(0.0))
    u = (F.pmod(F.xxhash64(F.lit(SEED), "mix_name", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("q", F.when(f > 1e-9, F.log(u / (1 - u)) - F.log(f / (1 - f))))
    fine = F.floor((F.col("q") + SPREAD) * (BUCKETS * BUCKETS / (2 * SPREAD)))
    fine = F.when(F.col("q").isNotNull(), F.least(F.lit(BUCKETS * BUCKETS - 1), F.greatest(F.lit(0), fine))).cast("long")
    rows = settle(rows.withColumn("fine", fine).withColumn("b", F.shiftright("fine", BUCKETS.bit_length() - 1)), "mix-ranks")
    key = ["mix_name", "source"]
    sure = rows.groupBy(*key).agg(F.sum(F.col("sure") * F.col("tokens")).alias("given"), F.first("need").alias("need"))
    want = sure.select(*key, (F.col("need") - F.col("given")).alias("want"))

    def edge(by: str, among: DataFrame, want: DataFrame) -> DataFrame:
        """(key, by, left): the bucket in which a source reaches what it wants, and what is left for it there."""
        sums = among.where(F.col(by).isNotNull()).groupBy(*key, by).agg(F.sum("tokens").alias("t"))
        upto = F.sum("t").over(Window.partitionBy(*key).orderBy(by))
        found = sums.withColumn("upto", upto).join(want, key).where((F.col("upto") - F.col("t") < F.col("want")) & (F.col("upto") >= F.col("want")))
        return found.select(*key, by, (F.col("want") - (F.col("upto") - F.col("t"))).alias("want"))

    # at most a row per target each
    coarse = F.broadcast(settle(edge("b", rows, want), "mix-coarse"))
    fine_edge = edge("fine", rows.join(coarse.select(*key, "b"), [*key, "b"], "left_semi"), coarse.select(*key, "want"))
    fine_edge = fine_edge.select(*key, F.col("fine").alias("edge"), F.col("want").alias("left"))
    # a source whose fractions don't reach its need takes them all
    ranked = rows.where("fine IS NOT NULL").join(F.broadcast(settle(fine_edge, "mix-edges")), key, "left")
    run = F.sum("tokens").over(Window.partitionBy(*key).orderBy("q", "id"))
    last = ranked.where("fine = edge").withColumn("run", run).where(F.col("run") - F.col("tokens") / 2 <= F.col("left")).select(*key, "id", F.lit(1).alias("extra"))
    below = ranked.where(F.coalesce("edge", F.lit(BUCKETS * BUCKETS)) > F.col("fine")).select(*key, "id", F.lit(1).alias("extra"))
    certain = rows.where("sure > 0").select(*key, "id", F.col("sure").alias("extra"))
    copies = certain.unionByName(below).unionByName(last).groupBy(*key, "id").agg(F.sum("extra").cast("int").alias("copies"))
    return copies.join(docs, ["id", "source"]).select("mix_name", "id", "source", "tokens", "copies")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents, most_copies) of every target."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = Window.partitionBy("mix_name")
    rows = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    return rows.select("mix_name", "source", "target_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(total)), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies")
