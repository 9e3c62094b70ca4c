"""Model stages: generation, repair, specialist mode, retries, entity extraction and model checks.

Each is a pass over all rows that need it: a retry is a second pass over the failed rows only, so the
number of passes is bounded and no question waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions import scores as S
from askmill.functions import text as X
from askmill.operators.answers import CANNOT, claim_list, parse_response, text_answer, verify
from askmill.plans.workspace import settle
from askmill.sources.connectors import Factory, completer, entailment, span_reader

# Our own wording.
FEEDBACK = "The evidence did not support the last answer. Read the facts again and take the answer from them word by word."
REPAIR = 'Give the answer and the fact numbers in this text as raw JSON {"supporting_fact_numbers": [..], "answer": ".."} and nothing else.\n\nText: '
SPECIALIST = '{question}\n\nRELEVANT FACTS:\n{facts}\n\nAnswer in one to five words taken from the facts. Reply with raw JSON {"answer": ".."} and nothing else.'
ENTITIES = "Question: {question}\n\nContext:\n{context}\nList the named entities of the context that link it to the answer and that the question doesn't name, as a JSON array of texts and nothing else."


def _ask(df: DataFrame, prompt: Column, make: Factory, model: str, temperature: float, out: str) -> DataFrame:
    """``df`` with a model's replies, written: a reply costs more than a table and is asked for once.

    The prompt is written first; Spark doesn't evaluate a Python function over higher-order functions.
    """
    df = settle(df.withColumn("_q", prompt), "asked")
    return settle(df.withColumn(out, completer(make, model, temperature)(F.col("_q"))).drop("_q"), "replies")


def _routed(df: DataFrame, prompt: Column, make: Factory, models: dict[str, tuple[str, float]], out: str) -> DataFrame:
    """Replies of the model that each row's route names, asked for in one pass."""
    df = settle(df.withColumn("_q", prompt), "asked")
    parts = [df.where(F.col("route") == name).withColumn(out, completer(make, model, t)(F.col("_q"))) for name, (model, t) in models.items()]
    return settle(parts[0].unionByName(parts[1]).drop("_q"), "replies")


def _repaired(df: DataFrame, broken: Column, text: str, make: Factory, models: dict[str, tuple[str, float]]) -> DataFrame:
    """Broken rows with the facts (and the answer that comes with them) of a second, plainer question about ``text``; ``df`` is a written table."""
    if df.where(broken).isEmpty():
        return df
    again = _routed(df.where(broken), F.concat(F.lit(REPAIR), F.substring(text, 1, 500)), make, models, "_r")
    again = again.withColumn("_p", parse_response(F.col("_r"), F.col("mapping")))
    found = F.size("_p.facts") > 0
    again = again.withColumns({"facts": F.when(found, F.col("_p.facts")).otherwise(F.col("facts")), "answer": F.when(found & (F.col("_p.answer") != ""), F.col("_p.answer")).otherwise(F.col("answer"))})
    return df.where(~broken).unionByName(again.drop("_r", "_p"))


def generate(prompts: DataFrame, make: Factory, small: str = "small", large: str = "large", temperatures: tuple[float, float] = (0.1, 0.3), repair: bool = True) -> DataFrame:
    """(…, response, answer, facts): the routed model's reply parsed; replies with an answer but no fact are repaired once,
    by the same model.  A failed call (NULL reply) gives the answer CANNOT and no facts."""
    models = {"simple": (small, temperatures[0]), "complex": (large, temperatures[1])}
    done = _routed(prompts, F.col("prompt"), make, models, "response")
    done = done.withColumn("r", parse_response(F.col("response"), F.col("mapping")))
    answer = F.when(F.col("response").isNull(), CANNOT).otherwise(X.numeric_answer(F.col("r.answer"), X.question_of_prompt(F.col("prompt")), F.col("prompt")))
    done = settle(done.withColumns({"answer": answer, "facts": F.col("r.facts")}).drop("r"), "generated")
    if not repair:
        return done
    broken = F.col("response").isNotNull() & (F.col("answer") != "") & (F.size("facts") == 0) & (F.coalesce(F.size("mapping"), F.lit(0)) > 0)
    return _repaired(done, broken, "response", make, {k: (m, 0.0) for k, (m, _) in models.items()})


def generate_specialist(prompts: DataFrame, make: Factory, small: str = "small", large: str = "large") -> DataFrame:
    """The large model picks facts (asked again if it picks none), the small one answers from those lines alone (from all
    if none was picked)."""
    picked = _ask(prompts, F.col("prompt"), make, large, 0.1, "_sp").withColumn("facts", parse_response(F.col("_sp"), F.col("mapping"))["facts"])
    picked = settle(picked.withColumn("answer", F.lit("")), "picked")
    broken = F.col("_sp").isNotNull() & (F.size("facts") == 0) & (F.coalesce(F.size("mapping"), F.lit(0)) > 0)
    picked = _repaired(picked, broken, "_sp", make, {"simple": (large, 0.0), "complex": (large, 0.0)}).drop("answer")
    numbers = F.map_keys(F.map_filter("mapping", lambda n, f: F.exists("facts", lambda x: (x["title"] == f["title"]) & (x["sentence_index"] == f["idx"]))))
    lines = F.filter(F.split("prompt", "\n"), lambda t: t.startswith("Fact "))
    kept = F.when(F.size(numbers) > 0, F.filter(lines, lambda t: F.array_contains(numbers, F.regexp_extract(t, r"^Fact (\d+):", 1).cast("int")))).otherwise(lines)
    question = F.concat(F.lit("QUESTION: "), X.question_of_prompt(F.col("prompt")))
    ask = F.replace(F.replace(F.lit(SPECIALIST), F.lit("{question}"), question), F.lit("{facts}"), F.array_join(kept, "\n"))
    said = _ask(picked, ask, make, small, 0.1, "_ans")
    answer = F.coalesce(F.nullif(X.strip(F.get_json_object(F.regexp_extract(X.without_thoughts(F.col("_ans")), r"\{[^{}]*\}", 0), "$.answer")), F.lit("")), text_answer(F.col("_ans")))
    failed = F.col("_sp").isNull() | F.col("_ans").isNull()
    none = F.array().cast("array<struct<title:string,sentence_index:int>>")
    return said.withColumns({"answer": F.when(failed, CANNOT).otherwise(X.normalize_generated(answer)), "facts": F.when(failed, none).otherwise(F.col("facts")), "response": F.concat(F.lit("[SP: "), "_sp", F.lit("]\n[ANS: "), "_ans", F.lit("]"))}).drop("_sp", "_ans")


def generate_with_prompt(rows: DataFrame, make: Factory, model: str, temperature: float = 0.3) -> DataFrame:
    """(…, response, answer, facts) of one model for rows (prompt, mapping)."""
    said = _ask(rows, F.col("prompt"), make, model, temperature, "response")
    return said.withColumn("r", parse_response(F.col("response"), F.col("mapping"))).withColumns({"answer": F.col("r.answer"), "facts": F.col("r.facts")}).drop("r")


def with_feedback(rows: DataFrame, answer: str | None = None) -> DataFrame:
    """The prompts with a line before them that says what was wrong with the last answer."""
    said = F.when(F.coalesce(answer, F.lit("")) != "", F.concat(F.lit(FEEDBACK), F.lit(' Answer given before: "'), answer, F.lit('".'))).otherwise(F.lit(FEEDBACK)) if answer else F.lit(FEEDBACK)
    return rows.withColumn("prompt", F.concat(said, F.lit("\n\n"), "prompt"))


def extract_entities(hop1: DataFrame, make: Factory | None, model: str = "large", most: int = 3) -> DataFrame:
    """(query_id, pos, entity) from rows (query_id, question, rank, title, sentences) of the best passages.

    The model's list (a JSON array, or the first bracket of its reply) and the titles, without what the
    question names, once each in any case; where there is no model or no list, the patterns of
    ``bridge_entities``.
    """
    q = hop1.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "title", "sentences"))).alias("ps"))
    named = F.flatten(F.transform("ps", lambda p: X.bridge_entities(p["title"], p["sentences"], F.col("question"), most)))
    if make is None:
        found = F.array_distinct(named)
    else:
        context = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("Title: "), F.coalesce(p["title"], F.lit("")), F.lit("\nText: "), F.substring(X.joined_text(p["sentences"]), 1, 800))), "\n\n")
        ask = F.replace(F.replace(F.lit(ENTITIES), F.lit("{question}"), F.col("question")), F.lit("{context}"), context)
        q = _ask(q, ask, make, model, 0.0, "_r")
        listed = F.from_json(F.regexp_extract("_r", r"(?s)\[.*?\]", 0), "array<string>")
        both = F.concat(listed, F.transform("ps", lambda p: p["title"]))
        clean = F.filter(F.transform(both, lambda e: X.strip(F.coalesce(e, F.lit("")))), lambda e: (e != "") & ~F.contains(F.lower("question"), F.lower(e)))
        low = F.transform(clean, lambda e: F.lower(e))
        once = F.filter(clean, lambda e, i: F.array_position(low, F.lower(e)) == i + 1)
        found = F.coalesce(once, F.array_distinct(named))
    return q.select("query_id", F.posexplode(found).alias("pos", "entity"))


def model_support(claims: DataFrame, make: Factory, mode: str = "nli", least: float = 0.2) -> DataFrame:
    """Adds ``support`` to rows (claim, text, overlap): lexical support blended with a model's.

    nli: 0.35 overlap + 0.65 max(0, entailment - 0.5 contradiction).  qa: 0.45 overlap + 0.55 of the reader's value: 0
    without a span, half its score below ``least``, else 0.7 score + 0.3 overlap of span and claim.  Where the model has no
    such method or fails, the overlap stands.
    """
    if mode == "nli":
        df = claims.withColumn("_s", entailment(make)(F.col("text"), F.col("claim")))
        return df.withColumn("support", F.coalesce(0.35 * F.col("overlap") + 0.65 * F.nullif("_s", F.lit(float("nan"))), F.col("overlap"))).drop("_s")
    df = settle(claims.withColumn("_s", span_reader(make)(F.col("claim"), F.col("text"))), "spans")
    score, span = F.nullif(F.col("_s.score"), F.lit(float("nan"))), F.coalesce("_s.span", F.lit(""))
    blend = F.least(F.lit(1.0), 0.7 * score + 0.3 * S.lexical_support(span, F.coalesce("claim", F.lit(""))))
    qa = F.when(X.strip(span) == "", F.lit(0.0)).when(score < least, score * 0.5).otherwise(blend)
    return df.withColumn("support", F.when(score.isNotNull(), 0.45 * F.col("overlap") + 0.55 * qa).otherwise(F.col("overlap"))).drop("_s")


def verified(rows: DataFrame, key: str, make: Factory, mode: str, answer: str, ids: str, texts: str, facts: str, **at: float) -> DataFrame:
    """``answers.verify`` with a model behind each pair of claim and evidence: pairs are scored as rows, each claim keeps its
    best, and the verdict is made from those."""
    pairs = rows.select(key, F.posexplode(claim_list(F.col(answer), at.get("most", 6))).alias("n", "claim"), F.col(texts).alias("_t")).select(key, "n", "claim", F.explode("_t").alias("text")).where(X.strip("text") != "")
    scored = model_support(settle(pairs.withColumn("overlap", S.lexical_support(F.col("claim"), X.strip("text"))), "claims"), make, mode)
    best = scored.groupBy(key, "n", "claim").agg(F.max("support").alias("s")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim", "s"))), lambda c: F.struct(c["claim"].alias("claim"), c["s"].alias("s"))).alias("_scored"))
    return verify(rows.join(best, key, "left"), answer, ids, texts, facts, scored="_scored", **at).drop("_scored")
