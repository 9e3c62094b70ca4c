from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askmill.llm import packing as P
from askmill.llm.tokens import count_tokens


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plan_places_every_item_once_within_capacity(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=80))
    plan = P.plan(dict(Counter(sizes)), capacity)
    placed = Counter()
    for n, items in plan:
        assert n > 0 and 0 < sum(items) <= capacity
        assert sum(3 * s > capacity for s in items) <= 2
        for s in items:
            placed[s] += n
    assert placed == Counter(sizes)
    containers = sum(n for n, _ in plan)
    assert containers <= max(1, 2 * -(-sum(sizes) // capacity))
    for s, (first, start, each) in P.slots(plan).items():
        assert list(first) == sorted(first) and len(first) == len(start) == len(each)


def test_best_fit_takes_the_smallest_gap():
    assert sorted((n, sorted(x)) for n, x in P.plan({7: 1, 8: 1, 2: 1, 3: 1}, 10)) == [(1, [2, 8]), (1, [3, 7])]


def test_placement(spark):
    sizes = [0, 0, None, 5, 5, 5, 9, 10, 11, 25, 3, 3, 1] * 7
    items = spark.createDataFrame([(i, s or 0) for i, s in enumerate(sizes)], "id long, tokens int").repartition(3)
    placed, n = P.place(items, {1: 10, 2: 30, 3: 0, 4: None})
    rows = placed.collect()
    assert {r.limit_id for r in rows} == {1, 2}
    for limit, cap in ((1, 10), (2, 30)):
        own = [r for r in rows if r.limit_id == limit]
        load, whole, parts = Counter(), Counter(), Counter()
        for r in own:
            load[r.container] += r.tokens
            whole[r.id] += r.tokens
            parts[r.id] += 1
        assert {i: whole[i] for i in range(len(sizes))} == {i: s or 0 for i, s in enumerate(sizes)}
        assert max(load.values()) <= cap and max(load) < n[limit]
        assert all(parts[i] == max(1, -(-(s or 0) // cap)) for i, s in enumerate(sizes))
    waste = {r.limit_id: r.unused_share for r in P.unused(placed, {1: 10, 2: 30}).collect()}
    assert waste[2] == pytest.approx(1 - sum(s or 0 for s in sizes) / 30 / n[2])


def test_no_documents_and_no_limits(spark):
    empty = spark.createDataFrame([], "id long, tokens int")
    assert P.place(empty, {1: 10})[0].count() == 0
    assert P.place(spark.createDataFrame([(1, 5)], "id long, tokens int"), {})[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "<|endoftext|>" + "a" * 50_000, "w")], "id long, text string, source string")
    got = {r.id: (r.tokens, r.source) for r in count_tokens(df, keep=["source"]).collect()}
    assert got[1] == (2, "x") and got[2] == (0, "y") and got[3] == (0, "z") and got[4][0] > 1000
