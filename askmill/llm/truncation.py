"""Texts cut off by field limits or broken transfers, and how often each source cuts.

A stack automaton reads each text to its end (``tails.scan``).  A text is complete if it ends outside any token and
with a terminator or another closing mark.  The others are judged in this order:

* broken: the text ends inside an escape, entity, tag or multibyte character;
* open: a quote, bracket or markup is still on the stack;
* terminator: the source ends at least BASELINE of its lines of this shape with a terminator, and here it is missing;
* word, place, limit: the baseline of the source says nothing about lines of this shape (its items, headings or
  labels have none, or it has no such lines), so the corpus statistics decide: the last word only begins known words,
  the place is one where sentences don't end, or bare ends of the source pile up at one length.

Writers leave out terminators too, so an accusation by ``open`` or ``terminator`` is checked: it falls where the word
is whole and the corpus shows that its place ends sentences (the longest telling context ends in ENDS of its
occurrences or more).  Dots that follow a cut (``...``) don't count as a terminator; their place must speak.

Defined cases: NULL, empty and blank texts are never cut; repeated rows are judged alike and copies bear no witness for
each other; a NULL source is a source of its own; ids must be unique; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.functions.text import strip
from askmill.llm import tails
from askmill.plans.workspace import settle

ENDS, ENDS_NUMBER = 0.12, 0.01
#: A source speaks about a shape if it has this many such lines, else all sources together do.
BASELINE, LINES = 0.9, 20
LETTERS = 8
PILE, AROUND, TIMES = 8, 8, 24

BARE = r"^[\s]*(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…)\s*\)|[,;:\-–—/&+\s(\[{«“‘\x{FFFD}])*$"
NUMERIC = r"^[0-9]"


def source_name(c: Column) -> Column:
    return F.lower(strip(c))


def piles(bare: DataFrame) -> DataFrame:
    """(src, n) at which the bare ends of a source pile up: lengths of a field limit.  Copies of a text count once."""
    by = bare.groupBy("src", "n").agg(F.count_distinct("copy").alias("k"))
    w = Window.partitionBy("src").orderBy("n")
    near = F.sum("k").over(w.rangeBetween(-AROUND, AROUND)) - F.col("k")
    return by.withColumn("near", near).where((F.col("k") >= PILE) & (F.col("k") * 2 * AROUND >= TIMES * F.greatest("near", F.lit(1)))).select("src", "n")


def baselines(tail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, shape, n, ended), (shape, all_n, all_ended)): lines of each shape and those that end with a terminator, by source
    and over all of them; each text once.

    Summed over (src, copy) first, so a group of copies is one row.
    """
    once = tail.groupBy("src", "copy").agg(F.first("lines").alias("lines"))
    by = settle(once.select("src", F.inline("lines")).groupBy("src", "shape").agg(F.sum("n").alias("lines_n"), F.sum("ended").alias("ended")), "baselines")
    return by, by.groupBy("shape").agg(F.sum("lines_n").alias("all_n"), F.sum("ended").alias("all_ended"))


def cut_word(silent: int = LETTERS) -> Column:
    """The last word is the beginning of other words rather than a word (numbers go on anyhow).

    ``silent``: how many times as frequent those must be where no context speaks at all.
    """
    times = F.when(F.col("p_end").isNull(), silent).otherwise(LETTERS)
    return ~F.col("word").rlike(NUMERIC) & (F.col("longer") > times * (F.col("seen") + 0.05))


def cut_place(ends: float) -> Column:
    """The context doesn't end anything here; numbers share their class with all of their length, so they need more."""
    number = F.col("word").rlike(NUMERIC)
    ended = F.coalesce(F.col("p_end") >= ends, F.lit(False))
    return F.coalesce(F.col("p_end") < F.when(number, ENDS_NUMBER).otherwise(ends), F.lit(False)) | (F.col("never_last") & ~(number & ended))


def judge(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(id, src, n, cut, why): every non-blank text with its verdict."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), source_name(F.col(source)).alias("src"))
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    tail = settle(tails.tails(docs.withColumn("copy", F.xxhash64("text")), ("src", "copy")), "tails")
    own, every = baselines(tail.select("src", "copy", "lines"))
    found = tails.judged(tail.drop("lines"), tails.counts(docs, tail))
    found = settle(found.withColumn("bare", F.coalesce(F.col("suffix").rlike(BARE), F.lit(False))).drop(*(f"c{i}" for i in range(tails.ORDERS + 1))), "judged")
    at_limit = piles(found.where("bare")).withColumn("at_limit", F.lit(True))
    # few rows per source: AQE broadcasts what is small by measure
    j = found.join(at_limit, ["src", "n"], "left")
    own = own.withColumnsRenamed({"src": "b_src", "shape": "b_shape"})
    j = j.join(own, j["src"].eqNullSafe(F.col("b_src")) & (j["shape"] == F.col("b_shape")), "left").join(every, "shape", "left")
    rate = F.when(F.col("lines_n") >= LINES, F.col("ended") / F.col("lines_n")).when(F.col("all_n") >= LINES, F.col("all_ended") / F.col("all_n"))
    j = j.withColumn("rate", rate)
    unclear = F.coalesce(F.col("p_end") < 0.5, F.lit(True))
    odd_word, odd_place = cut_word(silent=1), cut_place(ENDS)  # the word stands as it never does inside a text
    # dots after the word may be the writer's
    dotted = F.col("suffix").rlike(r"\.\.\.|…")
    stands = odd_word | odd_place | (F.col("p_end").isNull() & ~dotted)
    why = (
        F.when(F.col("broken"), "broken")
        .when(~F.col("bare"), None)
        .when((F.col("open") != "") & (unclear | odd_word), "open")
        .when(F.coalesce(F.col("rate") >= BASELINE, F.lit(False)), F.when(stands, "terminator"))
        .when(odd_word, "word")
        .when(odd_place, "place")
        .when(F.col("at_limit") & unclear, "limit")
    )
    return j.select("id", "src", "n", "word", "suffix", "shape", "rate", "p_end", "support", "seen", "longer", "open", why.alias("why")).withColumn("cut", F.col("why").isNotNull())


def rates(df: DataFrame, judged: DataFrame, source: str) -> DataFrame:
    """(source, texts, cut, rate): every source; texts without content count as texts."""
    all_ = df.groupBy(source_name(F.col(source)).alias("source")).agg(F.count("*").alias("texts"))
    cut = judged.where("cut").groupBy("src").agg(F.count("*").alias("cut"))
    both = all_.join(cut, all_["source"].eqNullSafe(cut["src"]), "left")
    return both.select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("rate"))
