import itertools
import random

import pytest
from pyspark.sql import functions as F

from askmill.llm import neardup as N

SCHEMA = "id long, title string, sentences array<string>, cls string, n int, words int"


def run(spark, rows, t, least):
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = N.near_duplicates(df, "id", N.passage_text(), t, least)
    return sorted(tuple(r) for r in N.expand_pairs(members, links).collect()), {r.id: r.links for r in N.groups(members, links).collect()}


def brute(rows, t, least):
    sets = {r[0]: set(" ".join([r[1] or "", *(s for s in r[2] or [] if s)]).lower().split()) for r in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12)


@pytest.mark.parametrize(("t", "least"), [(0.7, 20), (0.5, 3), (0.8, 1), (0.9, 5)])
def test_against_all_pairs(spark, t, least):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for g in range(40):
        base = rng.sample(common, rng.randint(2, 10)) + [f"w{rng.randint(0, 150)}" for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(1, 4)):
            words = [w for w in base if rng.random() > 0.08] + [f"w{rng.randint(0, 150)}" for _ in range(rng.randint(0, 4))]
            rng.shuffle(words)
            rows.append((len(rows), "T" if g % 2 else None, [" ".join(words[:9]), None, " ".join(words[9:])], "x", 1, 1))
    rows += [(1000, None, None, None, None, None), (1001, "", [], None, None, None), (1002, "x", [None], None, None, None)]
    rows += [(2000 + i, "same", [rows[0][2][0], rows[0][2][2]], None, None, None) for i in range(4)]
    got, links = run(spark, rows, t, least)
    want = brute(rows, t, least)
    assert got == want
    for i, n in links.items():
        assert n == sum(i in p for p in want)


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 0.7, 1) == ([], {})
    long = " ".join(f"w{i}" for i in range(60_000))
    assert run(spark, [(1, long, None, None, None, None), (2, long + " extra", None, None, None, None)], 0.8, 5)[0] == [(1, 2)]


def test_words(spark):
    got = spark.range(1).select(F.size(N.word_set(F.lit("Éa-b_c 12 12,x A"))).alias("n")).first().n
    assert got == 6  # éa, b, c, 12, x, a


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(50)] + [(200, 200 + i) for i in range(1, 30)] + [(300, 300)]
    head = {}
    for a, b in edges:
        head.setdefault(a, a), head.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    want = {x: h for x, h in head.items() if x != h}
    got = {r.cls: r.head for r in N.components(spark.createDataFrame(edges, "cls_a long, cls_b long")).collect()}
    assert got == want
    assert N.components(spark.createDataFrame([], "cls_a long, cls_b long")).count() == 0


def test_groups_join_chains_of_similar_texts(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, None, [" ".join(words[i : i + 20])], None, None, None) for i in range(6)] + [(50, "alone here", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.group_id, r.links) for r in N.groups(*N.near_duplicates(df, "id", N.passage_text(), 0.9, 1)).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 2), 3: (0, 2), 4: (0, 2), 5: (0, 1), 50: (50, 0)}
