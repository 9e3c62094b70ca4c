"""The k most similar vectors of every vector, by a hash-prefix forest.

Each of TREES trees hashes a vector to BITS sign bits of random rotations, a long hash string.  A tree is the sorted
array of all its hash strings; a node is a common prefix, so a run of the array.

1. Descent (``descend``).  In each tree every vector finds its place in the array.  Its longest prefix match is the
   longest prefix that it shares with a neighbour there; from it upwards its nodes grow.  For each tree the depths are
   noted at which the node of the vector has grown to 2, 4, 8, ... members.
2. Ascent (``ascend``).  All trees ascend together, one prefix length at a time, until the nodes of the vector at that
   depth have CANDIDATES members in all trees together: dense regions stop deep, sparse ones go further up.
3. Search (``search``).  In each tree the vector is compared with the members of its node at that depth, at most REACH to
   either side of its place in the array.  The best KEPT of all trees are its list.
4. Check (``check``).  Each list is compared exactly, all its members with each other too: what two members of a list
   are to each other may be missing in their own lists.  The k best are the neighbours.

The arrays are cut into ranges of about SPAN rows at quantiles of the hash strings (a documented sample of at most SAMPLE
vectors gives the bounds, every vector is indexed; at most RANGES a tree).  A vector whose node goes on in the next
range visits that range too.  A hash string that fills several ranges is spread over them by id.  So no task gets more
than a range and its visitors, however the data are skewed, and only the bounds are the driver's.  The descent moves ids
and hash strings, the search 16-bit codes (cosines are good to about 3e-5), the check the vectors as stored, whose similarities
are doubles.

Equal vectors are collapsed to one class before hashing, so a group of copies can't fill a node.  The loss of accuracy is
measured in tests and README (recall against brute force); CANDIDATES counts for each doubling of the collection.

Defined cases: only vectors of exactly ``dim`` finite numbers, not all zero, take part; NULL vectors and NULL
elements don't; ids must be unique; ties go to the smaller id; a collection of fewer than k + 1 vectors
gives each vector all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.plans.workspace import settle

TREES = 8
BITS = 60
CANDIDATES = 640
REACH = 4096
KEPT = 10
SPAN, RANGES, SAMPLE = 16_384, 4096, 1 << 18
#: Node sizes are noted at powers of two up to 2**STEPS.
STEPS = 16
#: Cosines of 16-bit codes are good to better than this.
ROUGH = 1e-4
#: Rows of one Python call where rows are gathered by id.
GATHER = 200_000
SEED = 20


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of the usable vectors."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = lists.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products along the last axis, added in the order of the elements."""
    s = x[..., 0] * y[..., 0]
    for d in range(1, x.shape[-1]):
        s = s + x[..., d] * y[..., d]
    return s


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(_dots(x, x))[..., None]


def usable(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """(id, v, fp): vectors as float32 bytes, with a fingerprint of the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _matrix(b.column(1), dim)
            prints = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in _units(x).astype(np.float32) + 0]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _blobs(x), pa.array(prints, pa.binary())], ["id", "v", "fp"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(vector).cast("array<float>")).mapInArrow(run, "id bigint, v binary, fp binary")


def _stored(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors."""
    return _units(_stored(column, dim)).astype(np.float32)


def rotations(dim: int, trees: int) -> np.ndarray:
    """Random orthogonal directions, dim x (trees * BITS); several rotations a tree where dim is less."""
    rng = np.random.default_rng(SEED)
    each = -(-BITS // dim)
    tree = lambda: np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(each)], axis=1)[:, :BITS]
    return np.concatenate([tree() for _ in range(trees)], axis=1).astype(np.float32)


def _hashes(x: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as integers, first bit highest: rows x trees."""
    signs = (x @ planes > 0).reshape(len(x), trees, -1)
    weight = (1 << np.arange(signs.shape[2] - 1, -1, -1)).astype(np.int64)
    return signs.astype(np.int64) @ weight


def _codes(x: np.ndarray, kind: type) -> np.ndarray:
    """Rows as scaled integers with their scale in the last four bytes."""
    most = np.iinfo(kind).max
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32) / most
    return np.concatenate([np.rint(x / scale).astype(kind).view(np.uint8), scale.view(np.uint8)], axis=1)


def _decoded(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    size = dim * np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[:, :size]).view(kind).astype(np.float32) * np.ascontiguousarray(raw[:, size:]).view(np.float32)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _ranges(bounds: np.ndarray, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Number of the range of each hash string; one that fills several ranges is spread over them by id."""
    last = np.searchsorted(bounds, h, side="right")
    times = last - np.searchsorted(bounds, h, side="left")
    return np.where(times > 1, last - ids % np.maximum(times, 1), last)


def growth(h: np.ndarray, bits: int) -> np.ndarray:
    """Depths at which the nodes of each string of a sorted array have grown to 2, 4, ... 2**STEPS members: rows x STEPS.

    The root (depth 0) stands for what never grows so far.
    """
    n = len(h)
    out = np.zeros((n, STEPS), np.int8)
    apart = h[1:] ^ h[:-1]
    shared = np.full(n + 1, -1)
    shared[1:n] = bits - np.where(apart > 0, np.frexp(apart.astype(np.float64))[1], 0)
    wide = apart >= 1 << 52  # where a double may round up to the next power
    if wide.any():
        shared[1:n][wide] = [bits - int(a).bit_length() for a in apart[wide]]
    open_rows = np.ones((n, STEPS), bool)
    for depth in range(bits, -1, -1):
        starts = np.flatnonzero(shared[:-1] < depth)
        size = np.diff(np.append(starts, n))
        if (size < 2).all():
            continue
        grown = np.repeat(np.frexp(size.astype(np.float64))[1] - 1, size)  # floor of the logarithm
        hit = (np.arange(1, STEPS + 1)[None, :] <= grown[:, None]) & open_rows
        out[hit] = depth
        open_rows &= ~hit
    return out


def stop_depths(steps: np.ndarray, enough: int, bits: int) -> np.ndarray:
    """The depth at which the synchronous ascent of each row stops; ``steps``: rows x trees x STEPS."""
    sizes = (1 << np.arange(1, STEPS + 1)).astype(np.int64)
    gain = np.diff(np.concatenate([[1], sizes]))  # members that a node has won at each step
    out = np.zeros(len(steps), np.int64)
    open_rows = np.ones(len(steps), bool)
    for depth in range(bits, 0, -1):
        total = steps.shape[1] + ((steps >= depth) * gain).sum(axis=(1, 2))
        hit = open_rows & (total >= enough)
        out[hit] = depth
        open_rows &= ~hit
    return out


def _bounds(heads: DataFrame, n: int, dim: int, planes: np.ndarray, trees: int, span: int) -> np.ndarray:
    """Bounds between the ranges of each tree, trees x (ranges - 1)."""
    ranges = min(RANGES, -(-n // span))
    if ranges < 2:
        return np.zeros((trees, 0), np.int64)
    some = max(1, n // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashes(_unpack(b.column(0), dim), planes, trees)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in h.T], [f"h{t}" for t in range(trees)])

    rows = heads.where(F.pmod(F.xxhash64("id"), F.lit(some)) == 0).select("v").mapInArrow(run, ", ".join(f"h{t} bigint" for t in range(trees)))
    at = [i / ranges for i in range(1, ranges)]
    found = rows.agg(*(F.percentile_approx(f"h{t}", at, max(10_000, 20 * ranges)).alias(f"h{t}") for t in range(trees))).first()  # one row
    return np.array([found[t] for t in range(trees)], np.int64)


def descend(heads: DataFrame, dim: int, planes: np.ndarray, trees: int, bounds: np.ndarray) -> DataFrame:
    """(id, steps): for each vector and tree the depths at which its nodes grow."""
    bits = planes.shape[1] // trees
    ranges = bounds.shape[1] + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h = b.column(0).to_numpy(), _hashes(_unpack(b.column(1), dim), planes, trees)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(t * ranges + _ranges(bounds[t], h[:, t], ids)), b.column(0), pa.array(h[:, t])], ["node", "id", "h"])

    def grow(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        order = np.argsort(h)
        steps = growth(h[order], bits)
        return pa.table({"id": t.column("id").take(pa.array(order)), "steps": _blobs(steps)})

    return heads.select("id", "v").mapInArrow(place, "node bigint, id bigint, h bigint").groupBy("node").applyInArrow(grow, "id bigint, steps binary")


def _gathered(rows: DataFrame, key: str, n: int, each: int):
    """``rows`` grouped so that all rows of a key meet in one call of about GATHER rows."""
    parts = max(1, -(-n * each // GATHER))
    return rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).groupBy("_part")


def ascend(grown: DataFrame, n: int, trees: int, enough: int, bits: int) -> DataFrame:
    """(id, depth): the depth of each vector's nodes when all trees together hold ``enough`` members."""

    def stop(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        steps = np.frombuffer(b"".join(t.column("steps").to_pylist()), np.int8).reshape(len(ids), STEPS)[order]
        one = ids[order][::trees]
        depths = [stop_depths(steps[lo * trees : (lo + 4096) * trees].reshape(-1, trees, STEPS), enough, bits) for lo in range(0, len(one), 4096)]
        return pa.table({"id": pa.array(one), "depth": pa.array(np.concatenate(depths).astype(np.int32) if depths else np.empty(0, np.int32))})

    return _gathered(grown, "id", n, trees).applyInArrow(stop, "id bigint, depth int")


def search(placed: DataFrame, dim: int, planes: np.ndarray, trees: int, bounds: np.ndarray, kept: int, reach: int) -> DataFrame:
    """(id, others, sims): for each tree the best candidates of each row of (id, v, depth), by 16-bit codes."""
    bits = planes.shape[1] // trees
    ranges = bounds.shape[1] + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                ids, depth, x = b.column(0).to_numpy(), b.column(2).to_numpy(), _unpack(b.column(1), dim)
                h, codes = _hashes(x, planes, trees), _blobs(_codes(x, np.int16))
                free = (bits - depth).astype(np.int64)
                for t in range(trees):
                    own = _ranges(bounds[t], h[:, t], ids)
                    low = h[:, t] >> free << free
                    before = np.flatnonzero((own > 0) & (np.searchsorted(bounds[t], low, side="right") < own))
                    after = np.flatnonzero((own < ranges - 1) & (np.searchsorted(bounds[t], low + (np.int64(1) << free) - 1, side="right") > own))
                    for rows, to, visits in ((np.arange(len(ids)), own, False), (before, own[before] - 1, True), (after, own[after] + 1, True)):
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(t * ranges + to), b.column(0).take(take), pa.array(h[rows, t]), b.column(2).take(take), pa.array(np.full(len(rows), visits)), codes.take(take)], ["node", "id", "h", "depth", "visits", "code"])

    def best(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column("id").to_numpy(), t.column("h").to_numpy()))))
        ids, h, depth, visits = (t.column(c).to_numpy() for c in ("id", "h", "depth", "visits"))
        x = _decoded(t.column("code"), dim, np.int16)
        points = np.flatnonzero(~visits)
        ph, px, pid = h[points], x[points], ids[points]
        free = (bits - depth).astype(np.int64)
        low = h >> free << free
        a, z = np.searchsorted(ph, low), np.searchsorted(ph, low + (np.int64(1) << free) - 1, side="right")
        here = np.clip(np.searchsorted(points, np.arange(len(ids))), a, z)
        a, z = np.maximum(a, here - reach), np.minimum(z, here + reach)
        parts = []
        for lo in range(0, len(ids), 256):
            q = slice(lo, lo + 256)
            left, right = int(a[q].min()), int(z[q].max())
            if right <= left:
                continue
            s = x[q] @ px[left:right].T
            at = np.arange(left, right)
            s[(at < a[q, None]) | (at >= z[q, None]) | (pid[left:right] == ids[q, None])] = -2
            row, col = _largest(s, kept)
            parts.append((lo + row, pid[left + col], s[row, col]))
        row, other, sim = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(ids)))).astype(np.int32))
        return pa.table({"id": pa.array(ids), "others": pa.ListArray.from_arrays(ends, pa.array(other, pa.int64())), "sims": pa.ListArray.from_arrays(ends, pa.array(sim, pa.float32()))})

    rows = placed.mapInArrow(place, "node bigint, id bigint, h bigint, depth int, visits boolean, code binary")
    return rows.groupBy("node").applyInArrow(best, "id bigint, others array<bigint>, sims array<float>")


def _largest(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` largest values of each row, rows in order.

    The ``most``-th of the maxima of 16 columns each is a bound that all of them reach.
    """
    rows, width = s.shape
    folds = width // 16
    if folds > 2 * most:
        maxima = s[:, : folds * 16].reshape(rows, 16, folds).max(axis=1)
        bound = np.partition(maxima, folds - most, axis=1)[:, folds - most]
    else:
        m = min(most, width)
        bound = np.partition(s, width - m, axis=1)[:, width - m]
    row, col = np.nonzero(s >= np.maximum(bound, -1.5)[:, None])
    order = np.lexsort((-s[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(rows))
    keep = np.arange(len(row)) - first[row] < most
    return row[keep], col[keep]


def _ranked(key: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` best different others of each key, keys in order."""
    order = np.lexsort((-sim, other, key))
    k, o = key[order], other[order]
    order = order[np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))] if len(order) else order
    order = order[np.lexsort((other[order], -sim[order], key[order]))]
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return order[np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k)))) < most]


def lists(found: DataFrame, n: int, trees: int, k: int, kept: int) -> DataFrame:
    """(id, near, least): the best of all trees, and the similarity that the k-th of them has."""

    def merge(t: pa.Table) -> pa.Table:
        lens = t.column("others").combine_chunks().value_lengths().to_numpy()
        key = np.repeat(t.column("id").to_numpy(), lens)
        other, sim = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("others", "sims"))
        at = _ranked(key, other, sim, kept)
        key, other, sim = key[at], other[at], sim[at]
        ids, first, count = np.unique(key, return_index=True, return_counts=True)
        least = np.where(count >= k, sim[first + np.minimum(k, count) - 1], -2).astype(np.float32) if len(ids) else np.empty(0, np.float32)
        near = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(other, pa.int64()))
        return pa.table({"id": pa.array(ids, pa.int64()), "near": near, "least": pa.array(least)})

    return _gathered(found, "id", n, trees).applyInArrow(merge, "id bigint, near array<bigint>, least float")


def check(heads: DataFrame, listed: DataFrame, n: int, dim: int, kept: int) -> DataFrame:
    """(a, b, sim): exact similarities within each list and its owner, as far as they may matter to ``a``."""

    vectors = heads.join(listed.select("id", "least"), "id").select("id", "v", "least")
    members = listed.select(F.col("id").alias("owner"), F.explode(F.concat(F.array("id"), "near")).alias("id"))
    rows = members.join(vectors, "id").select("owner", "id", "v", "least")

    def compare(t: pa.Table) -> pa.Table:
        owner, ids = t.column("owner").to_numpy(), t.column("id").to_numpy()
        order = np.lexsort((ids, owner))
        owner, ids, least = owner[order], ids[order], t.column("least").to_numpy()[order]
        x = _stored(t.column("v"), dim)[order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(owner)))
        out = []
        for m in np.unique(size):  # lists of one length at a time
            for at in np.array_split(first[size == m], -(-int((size == m).sum()) // 2048)):
                rows = at[:, None] + np.arange(m)
                y = _units(x[rows])
                s = _dots(y[:, :, None], y[:, None])
                s[:, np.arange(m), np.arange(m)] = -2
                g, i, j = np.nonzero(s >= least[rows][:, :, None] - ROUGH)
                keep = s[g, i, j] > -1.5
                g, i, j = g[keep], i[keep], j[keep]
                out.append((ids[rows[g, i]], ids[rows[g, j]], s[g, i, j]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2])})

    return _gathered(rows, "owner", n, kept + 1).applyInArrow(compare, "a bigint, b bigint, sim double")


def forest(heads: DataFrame, dim: int, k: int, trees: int = TREES, candidates: int = CANDIDATES, reach: int = REACH, kept: int = KEPT, span: int = SPAN) -> DataFrame:
    """(a, b, sim): similar vectors of (id, v), with the k nearest of each ``a`` among them but for the loss."""
    n = heads.count()
    kept = max(kept, k)
    planes = rotations(dim, trees)
    bounds = _bounds(heads, n, dim, planes, trees, span)
    enough = int(candidates * max(1.0, np.log2(max(n, 2))))
    depths = ascend(descend(heads, dim, planes, trees, bounds), n, trees, enough, BITS)
    placed = heads.join(depths, "id").select("id", "v", "depth")
    listed = settle(lists(search(placed, dim, planes, trees, bounds, kept, reach), n, trees, k, kept), "near-lists")
    return check(heads, listed, n, dim, kept)


def _first(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def nearest(df: DataFrame, id_col: str, vector: str, dim: int, k: int = 5, **how: int) -> DataFrame:
    """(id, other, sim): the k most similar others of each usable vector; ``how``: parameters of ``forest``."""
    all_ = settle(usable(df, id_col, vector, dim), "vectors")
    heads_of = all_.groupBy("fp").agg(F.min("id").alias("cls"))
    members = all_.select("id", "fp").join(heads_of, "fp").select("id", "cls")
    heads = settle(all_.join(heads_of.select(F.col("cls").alias("id")), "id", "left_semi").select("id", "v"), "vector-heads")
    found = forest(heads, dim, k, **how).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    top = _first(found, "a", [F.desc("sim"), F.asc("b")], k)
    few = _first(members, "cls", [F.asc("id")], k + 1).select(F.col("cls").alias("near"), F.col("id").alias("other"))
    reach = top.select(F.col("a").alias("cls"), F.col("b").alias("near"), "sim").unionByName(heads.select(F.col("id").alias("cls"), F.col("id").alias("near"), F.lit(1.0).alias("sim")))
    near = reach.join(few, "near").select("cls", "other", "sim")
    near = _first(near, "cls", [F.desc("sim"), F.asc("other")], k + 1)
    return _first(members.join(near, "cls").where("id <> other").select("id", "other", "sim"), "id", [F.desc("sim"), F.asc("other")], k)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of which at least one has the other among its nearest."""
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
