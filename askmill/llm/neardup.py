"""Near-duplicate texts by word-set Jaccard similarity, with pigeonring filtering.

Jaccard(A, B) >= t bounds the Hamming distance of the two word sets by tau = (1-t)/(1+t) * (|A|+|B|), and
forces |A n B| >= t * max(|A|, |B|).  The filter has three steps, none of which loses a pair:

1. Boxes.  Words are ordered by corpus frequency, rare first.  The first |A| - ceil(t|A|) + BOXES + 1 words
   of two similar sets share at least BOXES + 1 words; these fall into BOXES boxes by hash, so by the
   pigeonhole principle some box holds two shared words.  Rows meet on (box, pair of words).
2. Ring.  The whole set is hashed into SEGMENTS segments of 64 bits; popcount(xor) of a segment never
   exceeds its part of the Hamming distance.  Rows that met stay only if from some segment on every chain of
   1, 2, ... consecutive segments (around the ring) keeps within its proportional budget l * tau / SEGMENTS.
3. Full check on the word sets.

Equal word sets are collapsed to one class first, so a group of copies costs one row in the join; AQE
splits keys that stay hot.  Word frequencies come from all rows, folded into COUNTERS hash counters (a
bound that doesn't grow with the data; a collision changes only the order, never a result).

Defined cases: NULL titles, sentences and arrays are empty text; sets below ``least`` words pair with
nothing; equal sets are similar (1.0); ids must be unique; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.plans.workspace import settle

BOXES = 8
SHORT = 256
SEGMENTS = 4
COUNTERS = 1 << 18


def word_set(text: Column) -> Column:
    """64-bit hashes of the distinct runs of letters and digits of the lower-cased text, sorted."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def passage_text(title: str = "title", sentences: str = "sentences") -> Column:
    return F.concat_ws("\n", F.col(title), F.array_join(F.filter(F.col(sentences), lambda s: s.isNotNull()), "\n"))


def classes(df: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """(id, cls, n, words): each row with the class of its word set; ``cls`` is the least id of the class.

    Rows meet on a 128-bit fingerprint and the size of the set, partial minimum first.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), word_set(text).alias("words")).where(F.size("words") >= least)
    rows = rows.withColumn("n", F.size("words")).withColumn("fp", F.md5(F.array_join("words", ",")))
    rows = settle(rows, "wordsets")
    heads = rows.groupBy("fp", "n").agg(F.min("id").alias("cls"))
    return rows.join(heads, ["fp", "n"]).select("id", "cls", "n", "words")


def frequencies(rows: DataFrame) -> np.ndarray:
    """Word frequency of all rows by hash counter; a fixed number of counters."""
    counted = rows.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(COUNTERS)).cast("int").alias("k")).count()
    table = counted.toPandas()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[table["k"].to_numpy()] = table["count"].to_numpy()
    return out


def level(n: int, t: float) -> int:
    """Sets up to SHORT words are on level 0; each further level is 1/t longer, so partners are at most one apart."""
    return 0 if n <= SHORT else 1 + int(np.log(n / SHORT) / np.log(1 / t)) if t < 1 else n


def boxes(at: int, t: float) -> int:
    """Boxes of a level: so many that a box keeps a few words of a prefix, however long the sets."""
    return BOXES if at == 0 else max(BOXES, int((1 - t) * 0.4 * SHORT * (1 / t) ** (at - 1) if t < 1 else 0))


def _box_keys(words: np.ndarray, counts: np.ndarray, t: float) -> np.ndarray:
    n = len(words)
    order = np.lexsort((words, counts[words % COUNTERS]))
    least = int(np.ceil(t * n - 1e-9))
    own = level(n, t)
    keys = []
    for at in dict.fromkeys((own, level(int(n / t + 1e-9), t))):
        m = boxes(at, t)
        prefix = words[order[: n - least + m + 1]]
        box = ((prefix.view(np.uint64) >> np.uint64(24)) % np.uint64(m)).astype(np.int64)
        by = np.lexsort((prefix, box))
        prefix, box = prefix[by], box[by]
        step = 1
        while step < len(prefix):  # pairs of one box, by distance in it
            same = box[step:] == box[:-step]
            if not same.any():
                break
            keys.append(prefix[:-step][same] * np.int64(-7046029254386353131) + prefix[step:][same] * np.int64(6364136223846793005) + box[step:][same] * np.int64(2862933555777941757) + np.int64(at))
            step += 1
    if least <= BOXES:  # too few common words for a full box: any one of the rarest
        keys.append(words[order[: n - least + 1]] ^ np.int64(0x5DEECE66D))
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)


def _ring(words: np.ndarray) -> list[int]:
    u = words.view(np.uint64)
    segment, bit = (u >> np.uint64(20)) % np.uint64(SEGMENTS), np.uint64(1) << (u >> np.uint64(32)) % np.uint64(64)
    return [int(np.bitwise_or.reduce(bit[segment == s]).view(np.int64)) if (segment == s).any() else 0 for s in range(SEGMENTS)]


def signatures(heads: DataFrame, counts: np.ndarray, t: float) -> DataFrame:
    """(cls, n, s0.., key) of each class: one row per box key."""
    shared = heads.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                lists = b.column(2)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                sets = [flat[ends[i] : ends[i + 1]] for i in range(b.num_rows)]
                with np.errstate(over="ignore"):
                    keys = [_box_keys(w, table, t) for w in sets]
                rings = np.array([_ring(w) for w in sets], np.int64).reshape(-1, SEGMENTS)
                times = np.array([len(k) for k in keys])
                spread = [np.repeat(c, times) for c in (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), *rings.T)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, spread), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], ["cls", "n", *(f"s{i}" for i in range(SEGMENTS)), "key"])

    schema = ", ".join(["cls bigint", "n int", *(f"s{i} bigint" for i in range(SEGMENTS)), "key bigint"])
    return heads.select("cls", "n", "words").mapInArrow(run, schema)


def _ring_holds(t: float) -> Column:
    """Some start from which every chain keeps within its budget."""
    tau = (F.col("a.n") + F.col("b.n")) * F.lit((1 - t) / (1 + t)) + F.lit(1e-6)
    d = [F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(SEGMENTS)]
    holds = F.lit(False)
    for start in range(SEGMENTS):
        chain, all_of = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS + 1):
            chain = chain + d[(start + length - 1) % SEGMENTS]
            all_of = all_of & (chain <= tau * F.lit(length / SEGMENTS))
        holds = holds | all_of
    return holds


def similar_classes(rows: DataFrame, t: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of all pairs of classes with Jaccard >= t, cls_a < cls_b."""
    heads = rows.where(F.col("id") == F.col("cls")).select("cls", "n", "words")
    signed = signatures(heads, frequencies(heads), t)
    sizes = (F.col("a.n") >= F.col("b.n") * t - 1e-6) & (F.col("b.n") >= F.col("a.n") * t - 1e-6)
    met = signed.alias("a").join(signed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & sizes & _ring_holds(t))
    maybe = met.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()
    side = lambda x: heads.select(F.col("cls").alias(f"cls_{x}"), F.col("words").alias(f"w_{x}"))
    full = maybe.join(side("a"), "cls_a").join(side("b"), "cls_b")
    common = F.size(F.array_intersect("w_a", "w_b"))
    sim = common / (F.size("w_a") + F.size("w_b") - common)
    return full.select("cls_a", "cls_b", sim.alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def near_duplicates(df: DataFrame, id_col: str, text: Column, t: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(membership, links): each row with its class, and the similar pairs of classes."""
    rows = settle(classes(df, id_col, text, least), "classes")
    return rows.select("id", "cls"), settle(similar_classes(rows, t), "links")


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All similar pairs of rows (a < b): within a class, and across linked classes."""
    a, b = members.select(F.col("id").alias("x"), F.col("cls").alias("cls_a")), members.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
    across = links.join(a, "cls_a").join(b, "cls_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.unionByName(within)


def components(links: DataFrame, a: str = "cls_a", b: str = "cls_b") -> DataFrame:
    """(cls, head): the least class that each linked class can reach, by alternating large and small stars.

    A large star joins the greater neighbours of a class to the least of its neighbourhood, a small star the others;
    each step keeps as many rows as there are links, and the number of steps grows with the logarithm of the
    longest chain.  Minima are taken map-side, so a class with many links is no single task.
    """
    edges = settle(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "star")
    last = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = settle(small, "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if state == last:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("head"))
        last = state


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, group_id, links): one row per text with its class of equal sets, the group that links connect it with (its
    least class) and the number of rows similar to it."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"))
    ends = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(links.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    reach = ends.join(sizes.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("size").alias("far"))
    heads = components(links)
    rows = members.join(sizes, "cls").join(reach, "cls", "left").join(heads, "cls", "left")
    return rows.select("id", "cls", F.coalesce("head", "cls").alias("group_id"), (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
