"""Passages and examples: parsing, the deduplicated passage index, projections and corpus statistics.

NULL arrays count as empty, NULL elements are skipped in texts but keep their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.functions.text import integer_text, joined_text, strip, title_text

CONTEXT = "struct<title:string,sentences:array<string>,passage_id:string>"


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def parse_raw(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw JSON records in the parsed form, JVM-side: both spellings of keys, list or object entries.

    An entry of no known shape is dropped, a text that isn't one is dropped from a list entry's
    sentences, an index that is no integer becomes 0 in a list fact.  Unreadable payloads give NULL
    columns.
    """
    d = raw.withColumn("_v", F.try_parse_json(payload))
    get = lambda *keys: F.coalesce(*(F.nullif(F.try_variant_get("_v", f"$.{k}", "string"), F.lit("")) for k in keys), F.lit(""))
    parts = lambda key: _list(F.from_json(F.get_json_object(payload, f"$.{key}"), "array<string>"), "string")
    as_list = lambda e: F.from_json(e, "array<string>")
    as_object = lambda e, fields: F.from_json(e, f"struct<{fields}>")
    texts = lambda j: F.from_json(j, "array<string>")

    def context(e: Column) -> Column:
        from_list = F.struct(strip(F.get(as_list(e), F.lit(0))).alias("title"), F.transform(texts(F.get(as_list(e), F.lit(1))), strip).alias("sentences"), F.lit(None).cast("string").alias("passage_id"))
        o = as_object(e, "title:string,sentences:array<string>,passage_id:string")
        from_object = F.struct(strip(o["title"]).alias("title"), o["sentences"].alias("sentences"), o["passage_id"].alias("passage_id"))
        return F.when(e.startswith("["), F.when(F.size(as_list(e)) == 2, from_list)).when(e.startswith("{"), F.when(o["title"].isNotNull(), from_object))

    def fact(e: Column) -> Column:
        from_list = F.struct(strip(F.get(as_list(e), F.lit(0))).alias("title"), F.coalesce(integer_text(F.get(as_list(e), F.lit(1))).cast("int"), F.lit(0)).alias("sentence_index"))
        o = as_object(e, "title:string,sentence_index:string")
        from_object = F.struct(strip(o["title"]).alias("title"), integer_text(o["sentence_index"]).cast("int").alias("sentence_index"))
        return F.when(e.startswith("["), F.when(F.size(as_list(e)) == 2, from_list)).when(e.startswith("{"), F.when(o["title"].isNotNull(), from_object))

    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    return d.select("row_id", get("_id", "id").alias("id"), strip(get("question")).alias("question"), strip(get("answer")).alias("answer"), known(F.transform(known(parts("context")), context)).alias("contexts"), known(F.transform(known(parts("supporting_facts")), fact)).alias("supporting_facts"), get("type", "question_type").alias("question_type"), get("level").alias("question_level"), "source_file")


def passage_texts(passages: DataFrame) -> DataFrame:
    return passages.select("passage_idx", joined_text(F.col("sentences")).alias("text"), title_text(F.col("title"), F.col("sentences")).alias("title_text"))


def membership(passages: DataFrame) -> DataFrame:
    """(passage_idx, title, text): the key by which passages are copies of each other."""
    return passages.select("passage_idx", F.coalesce(strip("title"), F.lit("")).alias("title"), joined_text(F.col("sentences")).alias("text"))


def first_of(passages: DataFrame) -> DataFrame:
    """(passage_idx, first): the first stored passage of the same title and text.  Copies meet on two hashes,
    so no text is shuffled and a large group is a map-side minimum."""
    rows = membership(passages).select("passage_idx", F.struct(F.xxhash64("title", "text").alias("h"), F.md5(F.to_binary(F.to_json(F.struct("title", "text")), F.lit("utf-8"))).alias("m")).alias("key"))
    firsts = rows.groupBy("key").agg(F.min("passage_idx").alias("first"))
    return rows.join(firsts, "key").select("passage_idx", "first")


def passage_index(passages: DataFrame) -> DataFrame:
    """One row per (title, text), the first stored wins; ids count in that order.

    Duplicates meet on a hash of title and text with a map-side minimum.  Ids are numbered by range
    partition: sort once, count per partition, add offsets; no task sees all rows.
    """
    first = membership(passages).groupBy("title", "text").agg(F.min("passage_idx").alias("passage_idx"), F.count("*").alias("copies"))
    return with_position(first, "passage_idx").select("passage_idx", F.concat("title", F.lit("::"), F.col("position").cast("string")).alias("passage_id"), "copies", "position")


def with_position(df: DataFrame, order: str) -> DataFrame:
    """``position`` 0, 1, ... in the order of a unique column, in two passes over range partitions."""
    from askmill.plans.workspace import settle

    ranged = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.join(F.broadcast(starts), "_part").withColumn("position", within + F.col("_start")).drop("_part", "_start")


def contexts_of(examples: DataFrame, gold: bool) -> DataFrame:
    """(row_id, pos, title) of contexts whose title a fact cites, or of the others."""
    cited = F.transform(F.filter(_list(F.col("supporting_facts"), "struct<title:string,sentence_index:int>"), lambda f: f["title"].isNotNull()), lambda f: f["title"])
    rows = examples.select("row_id", cited.alias("cited"), F.posexplode("contexts").alias("pos", "c")).where(F.col("c").isNotNull())
    inside = F.coalesce(F.array_contains("cited", F.col("c.title")), F.lit(False))
    return rows.where(inside if gold else ~inside).select("row_id", "pos", F.col("c.title").alias("title"))


def gold_sentences(examples: DataFrame) -> DataFrame:
    """(row_id, fact_pos, sentence): cited sentences in the order of facts; the last context of a title counts."""
    rows = examples.select("row_id", "contexts", F.posexplode("supporting_facts").alias("fact_pos", "f")).where(F.col("f.title").isNotNull())
    same = F.filter(_list(F.col("contexts"), CONTEXT), lambda c: c["title"] == F.col("f.title"))
    i = F.col("f.sentence_index")
    sentence = F.when(i >= 0, F.get(F.try_element_at(same, F.lit(-1))["sentences"], i))
    return rows.select("row_id", "fact_pos", sentence.alias("sentence")).where(F.col("sentence").isNotNull())


def title_index(passages: DataFrame) -> DataFrame:
    """(title, passages, first_idx): passages by trimmed title.  Members stay rows (join on title), so a frequent title is no one row."""
    t = passages.select(strip("title").alias("title"), "passage_idx").where(F.col("title") != "")
    return t.groupBy("title").agg(F.count("*").alias("passages"), F.min("passage_idx").alias("first_idx"))


def corpus_stats(examples: DataFrame) -> DataFrame:
    """(name, value): numbers of examples by type and level, distinct passages, average contexts and facts."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast(dict(examples.dtypes)[c])))
    e = examples.select(F.coalesce("question_type", F.lit("")).alias("t"), F.coalesce("question_level", F.lit("")).alias("l"), size("contexts").alias("c"), size("supporting_facts").alias("s"))
    named = lambda p, c: e.groupBy(c).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit(p), F.col(c)).alias("name"), "value")
    whole = e.agg(F.count("*").cast("double").alias("examples"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("avg_contexts"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("avg_facts"))
    flat = whole.select(F.expr("stack(3, 'examples', examples, 'avg_contexts', avg_contexts, 'avg_facts', avg_facts) as (name, value)"))
    unique = examples.select(F.explode("contexts").alias("c")).where(F.col("c").isNotNull()).select(F.coalesce("c.title", F.lit("")).alias("t"), joined_text(F.col("c.sentences")).alias("x")).distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("unique_passages").alias("name"), "value")
    return flat.unionByName(unique).unionByName(named("type:", "t")).unionByName(named("level:", "l"))


def load(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows in stored order; all of them without a limit."""
    return df if limit is None else df.orderBy(order).limit(limit)


class Collection:
    """A numbered collection: its size, single rows by number, and iteration without collecting it."""

    def __init__(self, df: DataFrame, order: str) -> None:
        self.rows = with_position(df, order)

    def __len__(self) -> int:
        return self.rows.count()

    def __getitem__(self, number: int):
        n = number if number >= 0 else len(self) + number
        row = self.rows.where(F.col("position") == n).first()
        if row is None:
            raise IndexError(number)
        return row

    def __iter__(self):
        return self.rows.orderBy("position").toLocalIterator()

    def __repr__(self) -> str:
        return f"Collection({len(self)} rows)"


def full_contexts(examples: DataFrame) -> DataFrame:
    """(row_id, text): title and text of all contexts of a record, one to a line; NULL contexts are left out."""
    known = F.filter(_list(F.col("contexts"), CONTEXT), lambda c: c.isNotNull())
    return examples.select("row_id", F.array_join(F.transform(known, lambda c: title_text(c["title"], c["sentences"])), "\n").alias("text"))
