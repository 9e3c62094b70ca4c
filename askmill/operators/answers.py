"""From a model's response to a decided answer: parsing, citation mapping, verification, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from askmill.functions import scores as S
from askmill.functions import text as X

FACT = "struct<title:string,sentence_index:int>"
OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
# Fixed value: the answer of a question whose call failed.
CANNOT = "Cannot answer based on the provided evidence."
PARSED = "answer string, supporting_fact_numbers string, supporting_facts string, supportiing_facts string"


def _no_facts() -> Column:
    return F.array().cast(f"array<{FACT}>")


def _mapped(numbers: Column, mapping: Column) -> Column:
    """Facts of known numbers, in order; unknown numbers are dropped.  ``mapping``: MAP<INT, (title, index)>."""
    found = F.transform(F.filter(numbers, lambda n: n.isNotNull()), lambda n: F.element_at(mapping, n))
    return F.coalesce(F.transform(F.filter(found, lambda f: f.isNotNull()), lambda f: f.cast(FACT)), _no_facts())


def _ints(items: Column) -> Column:
    return F.transform(items, lambda x: X.integer_text(x).cast("int"))


def text_answer(response: Column) -> Column:
    """The answer part of free text: after the last marker, by pattern, or the first usable line."""

    def pick(t: Column) -> Column:
        by = lambda p: F.when(t.rlike(p), X.strip(F.regexp_extract(t, p, 1)))
        line = F.get(F.filter(F.transform(F.split(t, "\n"), X.strip), lambda x: ~x.startswith("Fact") & ~x.startswith("[") & (F.length(x) > 2)), F.lit(0))
        return F.coalesce(by(r'(?i)"answer"\s*:\s*"((?:[^"\\]|\\.)*)"'), by(r"(?i)(?:The\s+)?answer\s+is:?\s*([^\n]+?)(?:\.|$)"), by(r"(?i)Answer:\s*([^\n]+)"), line, t)

    def after(t: Column) -> Column:
        last = t
        for marker in ("RESPOND WITH", "TASK:", "RULES:"):
            last = F.regexp_replace(last, f"(?s)^.*{marker}", "")
        return F.when(F.contains(t, F.lit("Evidence:")) & F.contains(t, F.lit("QUESTION:")), last).otherwise(t)

    return X.let(X.let(X.strip(response), after), pick)


def parse_response(response: Column, mapping: Column, passages: Column | None = None) -> Column:
    """STRUCT(answer, facts, stage) of a response.

    Stage 1 reads a JSON object: its answer stays as it is, its fact numbers are looked up, else its pairs
    [passage, sentence] (``passages``: ARRAY of titles).  Stage 2 finds both by pattern in broken JSON.  Stage 3
    takes free text and normalises the answer.  A stage ends the parse if it has an answer and a fact (or
    says that it cannot answer).  A NULL response gives an empty answer.
    """
    raw = F.coalesce(response, F.lit(""))
    out = lambda a, f, s: F.struct(a.alias("answer"), f.alias("facts"), F.lit(s).alias("stage"))
    done = lambda r: (r["answer"] != "") & ((F.size(r["facts"]) > 0) | F.contains(F.lower(r["answer"]), F.lit("cannot")))

    def stage1(clean: Column) -> Column:
        def of(o: Column) -> Column:
            numbers = _mapped(_ints(F.from_json(o["supporting_fact_numbers"], "array<string>")), mapping)
            pairs = F.filter(F.coalesce(F.from_json(F.coalesce(o["supporting_facts"], o["supportiing_facts"]), "array<array<string>>"), F.array().cast("array<array<string>>")), lambda p: (F.size(p) >= 2) & X.integer_text(F.get(p, F.lit(1))).isNotNull())
            name = lambda p: F.coalesce(F.get(passages, X.integer_text(F.get(p, F.lit(0))).cast("int")), F.get(p, F.lit(0))) if passages is not None else F.get(p, F.lit(0))
            cited = F.transform(pairs, lambda p: F.struct(name(p).alias("title"), X.integer_text(F.get(p, F.lit(1))).cast("int").alias("sentence_index")).cast(FACT))
            return out(F.coalesce(X.strip(o["answer"]), F.lit("")), X.let(numbers, lambda n: F.when(F.size(n) > 0, n).otherwise(F.coalesce(cited, _no_facts()))), 1)

        whole = lambda j: F.when(F.try_parse_json(j).isNotNull(), F.from_json(j, PARSED))  # noqa: E731  (from_json alone takes parts)
        return X.let(X.let(F.nullif(F.regexp_extract(clean, OBJECT, 0), F.lit("")), whole), of)

    def stage2(clean: Column) -> Column:
        numbers = F.regexp_extract_all(F.regexp_extract(clean, r'"supporting_fact(?:s|_numbers?)"\s*:\s*\[([^\]]*)\]', 1), F.lit(r"(\d+)"), 1)
        return out(X.strip(F.regexp_extract(clean, r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)), _mapped(_ints(numbers), mapping), 2)

    has_map = F.coalesce(F.size(mapping), F.lit(0)) > 0

    def stage3(r: Column) -> Column:
        answer = X.normalize_generated(F.when(r["answer"] != "", r["answer"]).otherwise(text_answer(raw)))
        single = F.regexp_extract_all(raw, F.lit(r"(?i)\bfact\s+(\d+)"), 1)
        listed = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)(?:fact\s+numbers?|supporting_fact[^\n\[]*)\s*:?\s*\[([^\]]+)\]"), 1), lambda x: F.split(x, r"\s*,\s*")))
        free = _mapped(F.array_sort(F.array_distinct(_ints(F.concat(single, listed)))), mapping)
        tail = F.regexp_extract(raw, r"(?s)Supporting facts:(.*?)(?:Answer:|$)", 1)
        bracket = F.transform(F.regexp_extract_all(tail, F.lit(r"(\[[^\]]+,\s*\d+\])"), 1), lambda x: F.struct(X.strip(F.regexp_extract(x, r"\[([^\]]+),\s*\d+\]", 1)).alias("title"), F.regexp_extract(x, r",\s*(\d+)\]", 1).cast("int").alias("sentence_index")).cast(FACT))
        facts = F.when(F.size(r["facts"]) > 0, r["facts"]).otherwise(X.let(free, lambda f: F.when(has_map & (F.size(f) > 0), f).otherwise(bracket)))
        return out(answer, facts, 3)

    def both(clean: Column) -> Column:
        def second(a: Column) -> Column:
            def merged(b: Column) -> Column:
                try2 = (a["answer"] == "") & has_map
                rest = out(F.when(try2, b["answer"]).otherwise(a["answer"]), F.when(try2 & (F.size(a["facts"]) == 0), b["facts"]).otherwise(a["facts"]), 3)
                return F.when(done(a), a).when(try2 & done(b), b).otherwise(X.let(rest, stage3))

            return X.let(stage2(clean), merged)

        return X.let(stage1(clean), second)

    return X.let(X.without_thoughts(raw), both)


def invalid_citations(facts: Column, available: Column) -> Column:
    """Cited facts that weren't offered; a diagnostic that changes nothing."""
    return F.array_except(facts, available)


def claim_list(answer: Column, most: int = 6) -> Column:
    """The claims of an answer; the whole answer where it has none."""
    return X.let(X.claims(answer, most), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(answer)))


def evidence_items(df: DataFrame, column: str) -> DataFrame:
    """Replaces a column of evidence by ``ids`` and ``texts``, whichever of four forms it has: an array of (title, sentences),
    of (title, idx, text) or of texts, or a map id -> text.  Ids are ``title::index``, texts alone are numbered."""
    kind, c = df.schema[column].dataType, F.col(column)
    item = lambda i, t: F.struct(i.cast("string").alias("i"), t.alias("t"))
    at = lambda title, i: F.concat(F.coalesce(title, F.lit("")), F.lit("::"), i.cast("string"))
    inner = kind.elementType if isinstance(kind, ArrayType) else None
    if isinstance(inner, StructType) and "sentences" in inner.names:
        items = F.flatten(F.transform(c, lambda p: F.transform(F.coalesce(p["sentences"], F.array().cast("array<string>")), lambda s, i: item(at(p["title"], i), s))))
    elif isinstance(inner, StructType):
        items = F.transform(c, lambda p: item(at(p["title"], p["idx"]), p["text"]))
    elif inner is not None:
        items = F.transform(c, lambda t, i: item(F.concat(F.lit("evidence::"), i.cast("string")), t))
    else:
        items = F.array_sort(F.transform(F.map_entries(c), lambda e: item(e["key"], e["value"])))
    df = df.withColumn(column, items)
    return df.withColumns({"ids": F.transform(column, lambda x: x["i"]), "texts": F.transform(column, lambda x: x["t"])}).drop(column)


def verify(df: DataFrame, answer: str, ids: str, texts: str, facts: str, claim_at: float = 0.45, support_at: float = 0.55, ratio_at: float = 1.0, most: int = 6, scored: str | None = None) -> DataFrame:
    """Adds support_score, is_supported, unsupported, claims and coverage.

    ``scored`` may hold the claims with their support by a model (array of (claim, s)) in place of the lexical one.

    ``ids`` (``title::index``) and ``texts`` are parallel arrays of evidence, ``facts`` the cited ids.  Each claim takes
    its best evidence; yes and no are judged by the amount of evidence.  No answer or no evidence gives 0.
    """
    a = X.strip(F.coalesce(answer, F.lit("")))
    list_of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    items = F.filter(F.arrays_zip(list_of(ids).alias("i"), list_of(texts).alias("t")), lambda e: X.strip(F.coalesce(e["t"], F.lit(""))) != "")
    df = df.withColumn("_a", a).withColumn("_e", items)
    df = df.withColumns({"_i": F.transform("_e", lambda e: e["i"]), "_t": F.transform("_e", lambda e: X.strip(e["t"]))})
    own = F.transform(claim_list(F.col("_a"), most), lambda c: F.struct(c.alias("claim"), F.array_max(F.transform("_t", lambda t: S.lexical_support(c, t))).alias("s")))
    yesno = F.array(F.struct(F.col("_a").alias("claim"), S.yesno_support(F.size(F.coalesce(facts, F.array().cast("array<string>"))), F.col("_i"), F.col("_t")).alias("s")))
    checks = F.when(F.lower("_a").isin("yes", "no", "noanswer"), yesno).otherwise(F.coalesce(F.col(scored), own) if scored else own)
    none = F.array().cast("array<struct<claim:string,s:double>>")
    df = df.withColumn("_c", F.when((F.col("_a") == "") | (F.size("_e") == 0), none).otherwise(checks))
    n = F.greatest(F.size("_c"), F.lit(1))
    support = F.aggregate(F.transform("_c", lambda c: F.round(c["s"], 4)), F.lit(0.0), lambda x, s: x + s) / n
    share = F.size(F.filter("_c", lambda c: c["s"] >= claim_at)) / n
    unsupported = F.when(F.size("_c") > 0, F.transform(F.filter("_c", lambda c: c["s"] < claim_at), lambda c: c["claim"])).otherwise(F.array("_a"))
    out = df.withColumns({"support_score": F.round(support, 4), "is_supported": (support >= support_at) & (share >= ratio_at), "unsupported": unsupported, "claims": F.size("_c"), "coverage": S.fact_coverage(F.coalesce(facts, F.array().cast("array<string>")), F.col("_i"))})
    return out.drop("_a", "_e", "_i", "_t", "_c")


def deduplicated(facts: Column) -> Column:
    """Facts once each, first ones first; incomplete ones are dropped."""
    return F.array_distinct(F.filter(facts, lambda f: f["title"].isNotNull() & f["sentence_index"].isNotNull()))


def passage_ids(facts: Column, passages: Column) -> Column:
    """Ids of the first passage with each fact's title and a sentence at its index; the title stands in for a missing id."""
    def first(f: Column) -> Column:
        i = f["sentence_index"]
        ok = F.filter(passages, lambda p: (p["title"] == f["title"]) & (i >= 0) & (i < F.size(p["sentences"])))
        p = F.get(ok, F.lit(0))
        return F.coalesce(F.nullif(p["passage_id"], F.lit("")), F.nullif(p["title"], F.lit("")))

    return F.array_distinct(F.filter(F.transform(deduplicated(facts), first), lambda x: x.isNotNull()))


def decide(answer: Column, support: Column, supported: Column, top_score: Column, abstain: bool = False) -> Column:
    """STRUCT(answer, confidence, supported)."""
    ok = F.coalesce(supported, F.lit(False))
    final = X.strip(F.coalesce(answer, F.lit("")))
    if abstain:
        rank = F.coalesce(S.sigmoid(top_score), F.lit(0.0))
        conf = F.round(F.when(support.isNull(), rank).otherwise(0.7 * support + 0.3 * rank), 4)
        final = F.when(support.isNotNull() & ~ok, F.lit("Insufficient evidence")).otherwise(final)
    else:
        conf = S.decision_confidence(support, ok, top_score)
    return F.struct(final.alias("answer"), conf.alias("confidence"), ok.alias("supported"))
