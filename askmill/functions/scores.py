"""Scores of answers, supporting facts, claims and rankings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askmill.functions.text import let, normalize_custom, normalize_official, verifier_terms, words


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def same_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, t: acc + F.least(times(a, t), times(b, t)))


def answer_score(prediction: Column, gold: Column) -> Column:
    """STRUCT(em, f1, prec, recall) of the official scorer; yes, no and noanswer count only when equal."""
    p, g = normalize_official(prediction), normalize_official(gold)
    special = lambda c: c.isin("yes", "no", "noanswer")
    pt, gt = words(p), words(g)
    same = F.when((special(p) | special(g)) & (p != g), F.lit(0)).otherwise(same_tokens(pt, gt))
    prec, recall = ratio(same, F.size(pt)), ratio(same, F.size(gt))
    return F.struct((p == g).cast("double").alias("em"), f_measure(prec, recall).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def fact_score(prediction: Column, gold: Column) -> Column:
    """STRUCT(em, f1, prec, recall) of two sets of facts; two empty sets match."""
    p, g = F.array_distinct(prediction), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    prec, recall = ratio(tp, F.size(p)), ratio(tp, F.size(g))
    em = ((tp == F.size(p)) & (tp == F.size(g))).cast("double")
    return F.struct(em.alias("em"), f_measure(prec, recall).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def plain_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 of the error analysis: multisets, no rule for yes and no."""
    pt, gt = words(normalize_official(prediction)), words(normalize_official(gold))
    same = same_tokens(pt, gt)
    return f_measure(ratio(same, F.size(pt)), ratio(same, F.size(gt)))


def custom_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 of the custom scorer: distinct common tokens over full lengths."""
    pt, gt = words(normalize_custom(prediction)), words(normalize_custom(gold))
    same = F.size(F.array_intersect(pt, gt))
    return f_measure(ratio(same, F.size(pt)), ratio(same, F.size(gt)))


def set_f1(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return f_measure(ratio(common, F.size(a)), ratio(common, F.size(b)))


def lexical_support(claim: Column, evidence: Column) -> Column:
    """0.75 precision + 0.25 F1 of the claim's terms in the evidence's."""

    def score(c: Column, e: Column) -> Column:
        both = F.struct(F.size(F.array_intersect(c, e)).alias("n"), F.size(c).alias("c"), F.size(e).alias("e"))
        rates = lambda s: F.struct(ratio(s["n"], s["c"]).alias("p"), ratio(s["n"], s["e"]).alias("r"))
        return let(let(both, rates), lambda s: F.least(F.lit(1.0), 0.75 * s["p"] + 0.25 * f_measure(s["p"], s["r"])))

    return let(verifier_terms(claim), lambda c: let(verifier_terms(evidence), lambda e: score(c, e)))


def rrf(rank: Column, k: int = 20) -> Column:
    """Reciprocal rank of a rank that counts from 0."""
    return 1.0 / (k + rank + 1)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def confidence(first: Column, second: Column) -> Column:
    """How far the best score is ahead of the next, in 0..1; 0 without a next or a positive best."""
    return F.when(second.isNotNull() & (first > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (first - second) / first))).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """A vector at length 1; the zero vector stays."""

    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
        return let(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(d, lambda x: x / n))

    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# Words that show a comparison (tested as substrings).
SIGNALS = "both also same different unlike whereas however but although while than more less not never neither nor".split()


def yesno_support(facts: Column, ids: Column, texts: Column) -> Column:
    """Support of a yes or no: by the number of facts, evidence items, titles, terms and words of comparison."""
    enough_facts, enough = F.coalesce(facts, F.lit(0)) >= 2, F.size(texts) >= 2
    base = F.when(enough_facts & enough, 0.65).when(enough_facts | enough, 0.40).otherwise(0.15)
    titles = F.size(F.array_distinct(F.transform(F.filter(ids, lambda i: F.contains(i, F.lit("::"))), lambda i: F.substring_index(i, "::", 1))))
    terms = F.aggregate(F.transform(texts, lambda t: F.size(verifier_terms(t))), F.lit(0), lambda a, n: a + n)
    all_text = F.lower(F.array_join(texts, " "))
    signals = sum((all_text.contains(w).cast("int") for w in SIGNALS), F.lit(0))
    bonus = F.when(titles >= 2, 0.10).when(titles == 1, 0.03).otherwise(0.0) + F.when(terms >= 15, 0.10).when(terms >= 8, 0.05).otherwise(0.0) + F.when(signals >= 3, 0.10).when(signals >= 1, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)


def fact_coverage(facts: Column, ids: Column) -> Column:
    """Share of cited ``title::index`` ids among the evidence ids; NULL where none is cited."""
    wanted = F.array_distinct(facts)
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, ids)) / F.size(wanted), 4))


def decision_confidence(support: Column, supported: Column, top_score: Column) -> Column:
    """0.7 support + 0.3 sigmoid of the best rerank score, halved if unsupported; without a check the latter alone."""
    rank = F.coalesce(sigmoid(top_score), F.lit(0.0))
    both = 0.7 * support + 0.3 * rank
    return F.round(F.when(support.isNull(), rank).when(supported, both).otherwise(both * 0.5), 4)
