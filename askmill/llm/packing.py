"""Filling fixed-capacity containers with whole items, by large-item matching.

Sizes are whole numbers up to the capacity C, so all that packing needs is how many items have each size:
a table of at most C rows, whatever the number of items.  On it the plan is made once, for all items:

* items above C are split: full containers of C and one rest, which is packed like any item;
* large items, above C/3, go at most two to a container: from the largest down, each is matched with the
  largest item that still fits beside it;
* smaller items, from the largest down, go to the container with the smallest gap that holds them (best
  fit); what fits nowhere opens a new container.

Equal containers are planned together: a class is a list of sizes and how many containers it has, and each
step fills or splits one class, so the plan has a few rows per size.  Items are then numbered within their
size (each task numbers its own rows, then the counts per task give the starts, so a frequent size needs
no single task) and find their container by looking that number up in the plan, which is broadcast: a few
rows per size.

Defined cases: NULL and empty texts have size 0 and go to container 0 of their limit, which they leave as
full as it is; repeated rows are items of their own; a NULL or non-positive capacity places nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.tokens import count_tokens
from askmill.plans.workspace import settle

Plan = list[tuple[int, list[int]]]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """[(containers, sizes in each)] for ``counts`` items of each size, 1 <= size <= capacity."""
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    classes: Plan = []
    while large:
        s = large[-1]
        at = bisect.bisect_right(large, capacity - s) - 1
        if at < 0:
            classes.append((left[s], [s]))
            large.pop()
            continue
        mate = large[at]
        pairs = left[s] // 2 if mate == s else min(left[s], left[mate])
        if not pairs:  # one item of the size that would match itself
            mate_at = at - 1
            if mate_at < 0:
                classes.append((1, [s]))
                large.pop()
                continue
            mate = large[mate_at]
            pairs = 1
        classes.append((pairs, [s, mate]))
        for x in (s, mate):
            left[x] -= pairs
        large = [x for x in large if left[x] > 0]
    gaps: list[tuple[int, int]] = []  # (gap, class number), sorted
    for i, (_, sizes) in enumerate(classes):
        bisect.insort(gaps, (capacity - sum(sizes), i))
    for s in sorted((x for x in left if left[x] > 0 and 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(gaps, (s, -1))
            if at == len(gaps):
                each = capacity // s
                full, rest = divmod(n, each)
                for k, m in ((full, each), (1 if rest else 0, rest)):
                    if k:
                        classes.append((k, [s] * m))
                        bisect.insort(gaps, (capacity - s * m, len(classes) - 1))
                n = 0
                continue
            gap, i = gaps.pop(at)
            k, sizes = classes[i]
            each = gap // s
            full, rest = min(k, n // each), n % each if n // each < k else 0
            parts = [(full, each), (1 if rest else 0, rest)]
            parts.append((k - sum(p[0] for p in parts), 0))
            kept = False
            for many, m in parts:
                if not many:
                    continue
                entry = (many, sizes + [s] * m)
                if not kept:
                    classes[i], where, kept = entry, i, True
                else:
                    classes.append(entry)
                    where = len(classes) - 1
                bisect.insort(gaps, (gap - s * m, where))
            n -= full * each + rest
    return classes


def slots(classes: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: first item number, first container and items per container of each class that takes it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for many, sizes in classes:
        for s in dict.fromkeys(sizes):
            m = sizes.count(s)
            out.setdefault(s, []).append((used.get(s, 0), container, m))
            used[s] = used.get(s, 0) + many * m
        container += many
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def sizes(df: DataFrame, id_col: str, text: str, tokenizer: str) -> DataFrame:
    """(id, tokens) of every document, measured once."""
    return settle(count_tokens(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")), tokenizer), "sizes")


def pieces(items: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(limit_id, id, piece, tokens): every item under every limit, those above it in pieces, all but the last full."""
    each = F.array(*(F.struct(F.lit(k).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("cap")) for k, c in limits.items()))
    rows = items.select("id", "tokens", F.explode(each).alias("l")).select("id", "tokens", "l.*")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap"))).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("limit_id", "id", "piece", F.least("cap", F.col("tokens") - F.col("piece") * F.col("cap")).cast("int").alias("tokens"))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each (limit, size) within the task."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | b.column(3).to_numpy(zero_copy_only=False)
        kinds, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        order = np.argsort(inv, kind="stable")
        start = np.repeat(np.cumsum(n) - n, n)
        number = np.empty(len(key), np.int64)
        number[order] = np.arange(len(key)) - start
        number += np.array([seen.get(k, 0) for k in kinds.tolist()], np.int64)[inv]
        for k, m in zip(kinds.tolist(), n.tolist()):
            seen[k] = seen.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(number)], [*b.schema.names, "part", "within"])


def place(items: DataFrame, limits: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """((limit_id, id, piece, tokens, container), containers by limit) of (id, tokens) under each limit."""
    limits = {k: c for k, c in limits.items() if c and c > 0}
    schema = "limit_id int, id bigint, piece int, tokens int"
    if not limits:
        return items.sparkSession.createDataFrame([], schema + ", container bigint"), {}
    rows = settle(pieces(items, limits).mapInArrow(_within, schema + ", part int, within bigint"), "pieces")
    per = settle(rows.groupBy("limit_id", "tokens", "part").agg(F.count("*").alias("n")), "piece-counts")
    table = per.groupBy("limit_id", "tokens").agg(F.sum("n").alias("n")).toPandas()  # at most a row per size and limit
    plans = {k: plan({t: n for t, n in zip(own["tokens"].tolist(), own["n"].tolist()) if t > 0}, limits[k]) for k, own in table.groupby("limit_id")}
    where = items.sparkSession.sparkContext.broadcast({k: slots(p) for k, p in plans.items()})
    before = Window.partitionBy("limit_id", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("limit_id", "tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limit, size, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            container = np.zeros(len(size), np.int64)
            key = limit.astype(np.int64) << 32 | size
            order = np.argsort(key, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []:
                if size[own[0]] > 0:
                    first, start, each = where.value[int(limit[own[0]])][int(size[own[0]])]
                    at = np.searchsorted(first, number[own], side="right") - 1
                    container[own] = start[at] + (number[own] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container)], ["limit_id", "id", "piece", "tokens", "container"])

    placed = rows.join(starts, ["limit_id", "tokens", "part"]).select("limit_id", "id", "piece", "tokens", (F.col("within") + F.col("start")).alias("number"))
    return placed.mapInArrow(look, schema + ", container bigint"), {k: sum(n for n, _ in p) for k, p in plans.items()}


def unused(placed: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(limit_id, containers, tokens, unused_share) from a placing; pre-aggregated by container."""
    capacity = F.create_map(*(x for k, c in limits.items() for x in (F.lit(k).cast("int"), F.lit(c).cast("int"))))
    by = placed.groupBy("limit_id", "container").agg(F.sum("tokens").alias("t"))
    all_ = by.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return all_.select("limit_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * capacity[F.col("limit_id")])).alias("unused_share"))
