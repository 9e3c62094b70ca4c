"""From ranked candidates to a prompt: reranking, sentence selection, evidence and fact blocks, routing.

All stages keep one row per (question, passage) or (question, passage, sentence) until the prompt is
assembled; texts join after the top k, so they aren't carried through ranking.  Scores come from a scorer
``f(question, text) -> Column``: the lexical one below, or a model behind ``connectors.model_scorer``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.functions import scores as S
from askmill.functions import text as X

Scorer = Callable[[Column, Column], Column]


def lexical_scorer(question: Column, text: Column) -> Column:
    """Share of the question's words that the text has."""
    return X.let(X.overlap_terms(question), lambda q: S.ratio(F.size(F.array_intersect(q, X.overlap_terms(text))), F.size(q)))


@dataclass(frozen=True)
class Selection:
    """How sentences are selected."""

    threshold: float = 0.4
    most: int = 5
    passages: int = 3
    boost: float = 0.05
    sure_first: int = 2  # of the two best passages
    sure_rest: int = 1


@dataclass(frozen=True)
class Routing:
    """Weights of the complexity score and where routing splits."""

    length: float = 0.10
    length_limit: int = 50
    keyword: float = 0.35
    gap: float = 0.20
    sentences: float = 0.35
    sentence_limit: int = 5
    split: float = 0.5
    # Words of a question that point to a bridge (tested as substrings).
    keywords: tuple[str, ...] = ("who", "which", "when", "where", "what", "how", "portrayed", "actor", "character", "played")


def rerank(candidates: DataFrame, scorer: Scorer = lexical_scorer, k: int = 5) -> DataFrame:
    """The k best candidates of each question; columns query_id, id, question, title, sentences, retrieval_rank stay."""
    s = candidates.withColumn("score", scorer(F.col("question"), X.title_text(F.col("title"), F.col("sentences"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "retrieval_rank", "id")
    return s.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def select_sentences(reranked: DataFrame, scorer: Scorer = lexical_scorer, how: Selection = Selection()) -> DataFrame:
    """(query_id, rank, title, idx, text, score): sentences kept of the best passages.

    Scores fall along the ranking, so stopping at the first miss equals: sure, or above the threshold
    among the first ``most``.
    """
    top = reranked.where(F.col("rank") < how.passages)
    rows = top.select("query_id", "id", "question", "title", "rank", F.posexplode("sentences").alias("idx", "raw")).withColumn("text", X.strip("raw")).where(F.col("text") != "")
    boost = F.when(F.arrays_overlap(X.overlap_terms(F.coalesce("title", F.lit(""))), X.overlap_terms("question")), how.boost).otherwise(0.0)
    rows = rows.withColumn("score", S.sigmoid(scorer(F.col("question"), F.col("text"))) + boost)
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), F.desc("text"), F.desc("idx"))
    sure = F.when(F.col("rank") < 2, how.sure_first).otherwise(how.sure_rest)
    place = rows.withColumn("_i", F.row_number().over(w) - 1)
    kept = place.where((F.col("_i") < sure) | ((F.col("score") >= how.threshold) & (F.col("_i") < how.most)))
    return kept.select("query_id", "rank", "title", "idx", "text", F.round("score", 4).alias("score"))


def _limited(selected: DataFrame) -> DataFrame:
    """The first sentences in text order: three of the two best passages, two of the others."""
    w = Window.partitionBy("query_id", "rank").orderBy("idx")
    return selected.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.when(F.col("rank") < 2, 3).otherwise(2))


def evidence_block(reranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, evidence): passages with their shown sentences; passages without sentences keep their title."""
    s = _limited(selected).groupBy("query_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(F.lit("\n  ["), x["idx"].cast("string"), F.lit("] "), X.shown(x["text"]))), "").alias("lines"))
    head = F.concat(F.lit("Passage "), F.col("rank").cast("string"), F.lit(": ["), F.coalesce("title", F.lit("")), F.lit("]"))
    rows = reranked.select("query_id", "rank", head.alias("head")).join(s, ["query_id", "rank"], "left").withColumn("block", F.concat("head", F.coalesce("lines", F.lit(""))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return rows.groupBy("query_id").agg(F.concat(F.lit("Evidence:\n"), F.array_join(ordered, "\n")).alias("evidence"))


def fact_rows(selected: DataFrame) -> DataFrame:
    """(query_id, number, title, idx, text): numbered facts over the passages in order."""
    w = Window.partitionBy("query_id").orderBy("rank", "idx")
    return _limited(selected).withColumn("number", F.row_number().over(w) - 1).select("query_id", "number", "title", "idx", "text")


def fact_block(selected: DataFrame) -> DataFrame:
    """(query_id, facts, mapping): the list of facts and number -> (title, idx)."""
    f = fact_rows(selected)
    line = F.concat(F.lit("Fact "), F.col("number").cast("string"), F.lit(": ["), F.coalesce("title", F.lit("")), F.lit(", "), F.col("idx").cast("string"), F.lit("] "), X.shown(F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"])
    mapping = F.map_from_entries(F.collect_list(F.struct("number", F.struct("title", "idx"))))
    return f.groupBy("query_id").agg(F.concat(F.lit("AVAILABLE FACTS:\n"), F.array_join(lines, "\n")).alias("facts"), mapping.alias("mapping"))


def complexity(reranked: DataFrame, selected: DataFrame, how: Routing = Routing()) -> DataFrame:
    """(query_id, complexity, route): from the question's length and words, the lead of the best passage and the number of sentences."""
    per = reranked.groupBy("query_id").agg(F.first("question").alias("question"), F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("b"))
    n = selected.groupBy("query_id").agg(F.count("*").alias("n"))
    j = per.join(n, "query_id", "left")
    named = F.lit(False)
    for w in how.keywords:
        named = named | F.lower("question").contains(w)
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") - F.col("b")) / (F.abs("a") + 1e-6)))
    doubt = F.when(F.col("b").isNull(), 0.5).otherwise(1.0 - lead)
    c = how.length * (F.length("question") > how.length_limit).cast("double") + how.keyword * named.cast("double") + how.gap * doubt + how.sentences * (F.coalesce("n", F.lit(0)) > how.sentence_limit).cast("double")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return j.select("query_id", F.round(score, 6).alias("complexity"), F.when(score > how.split, "complex").otherwise("simple").alias("route"))


# Our own wording; {question} and {facts} are filled in.
CITATION = "QUESTION: {question}\n\n{facts}\n\nTASK: Use only these facts. Reply with raw JSON and nothing else:\n{\"supporting_fact_numbers\": [numbers of the facts you used], \"answer\": \"a few words\"}"
YESNO = "QUESTION: {question}\n\n{facts}\n\nTASK: Decide by these facts alone whether it is so. Reply with raw JSON and nothing else:\n{\"supporting_fact_numbers\": [numbers of the facts you used], \"answer\": \"yes\" or \"no\"}"
STANDARD = "Question: {question}\n\nUse only the evidence. Reply with raw JSON and nothing else:\n{\"supporting_facts\": [[passage, sentence], ...], \"answer\": \"a few words\"}"


def prompts(reranked: DataFrame, selected: DataFrame, most: int = 6000, evidence_first: bool = True, citation: bool = True, how: Routing = Routing()) -> DataFrame:
    """(query_id, prompt, complexity, route, mapping): the whole prompt, cut at ``most`` letters from its end."""
    q = reranked.groupBy("query_id").agg(F.first("question").alias("question"))
    j = q.join(evidence_block(reranked, selected), "query_id").join(fact_block(selected), "query_id", "left").join(complexity(reranked, selected, how), "query_id")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{question}"), F.col("question")), F.lit("{facts}"), F.coalesce("facts", F.lit("AVAILABLE FACTS:")))
    asked = fill(CITATION) if citation else fill(STANDARD)
    if citation:
        asked = F.when(X.is_yesno_question(F.col("question")), fill(YESNO)).otherwise(asked)
    parts = [F.col("evidence"), asked] if evidence_first else [asked, F.col("evidence")]
    whole = F.concat_ws("\n\n", *parts)
    cut = F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n[... truncated ...]"))).otherwise(whole)
    return j.select("query_id", cut.alias("prompt"), "complexity", "route", "mapping")


def passage_facts(selected: DataFrame) -> DataFrame:
    """(query_id, mapping): number of a passage -> its selected (title, idx) in order, without the limits of the prompt."""
    per = selected.groupBy("query_id", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: F.struct(x["title"].alias("title"), x["idx"].alias("idx"))).alias("facts"))
    return per.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "facts")))).alias("mapping"))


def prompt_facts(prompted: DataFrame, reranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, passages, sentences, letters, mean_score): what went into each prompt."""
    r = reranked.groupBy("query_id").agg(F.count("*").alias("passages"), F.round(F.avg("score"), 6).alias("mean_score"))
    n = selected.groupBy("query_id").agg(F.count("*").alias("sentences"))
    j = prompted.select("query_id", F.length("prompt").alias("letters")).join(r, "query_id").join(n, "query_id", "left")
    return j.select("query_id", "passages", F.coalesce("sentences", F.lit(0)).alias("sentences"), "letters", "mean_score")
