import numpy as np
import pytest

from askmill.llm import mixing as M

TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def chosen(spark, docs, targets):
    d = spark.createDataFrame(docs, "id long, source string, tokens int")
    t = spark.createDataFrame(targets, TARGETS)
    c = M.choose(d, t)
    return c.collect(), {(r.mix_name, r.source): r for r in M.shares(c, t).collect()}


def test_shares_and_caps(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "big", int(x)) for i, x in enumerate(rng.integers(1, 400, 3000))] + [(5000 + i, "small", int(x)) for i, x in enumerate(rng.integers(1, 400, 60))]
    rows, s = chosen(spark, docs, [("m", "big", 0.6, 1), ("m", " Small ", 0.4, 3)])
    assert s["m", "small"].actual_share == pytest.approx(0.4, abs=0.01) and s["m", "big"].actual_share == pytest.approx(0.6, abs=0.01)
    assert max(r.copies for r in rows if r.source == "small") == 3 and {r.copies for r in rows if r.source == "big"} == {1}
    assert len({r.id for r in rows}) == len(rows)
    total = sum(t for _, x, t in docs if x == "small")
    assert s["m", "small"].tokens == pytest.approx(3 * total, rel=0.01)


def test_longer_documents_are_likelier(spark):
    docs = [(i, "a", 10 if i % 2 else 30) for i in range(4000)] + [(9000, "b", 1000)]
    rows, s = chosen(spark, docs, [("m", "a", 0.95, 1), ("m", "b", 0.05, 1)])
    long, short = (sum(r.tokens == t for r in rows if r.source == "a") for t in (30, 10))
    assert long / max(short, 1) == pytest.approx(3, rel=0.15)
    assert s["m", "a"].tokens == pytest.approx(19_000, rel=0.01)


def test_missing_sources_empty_documents_and_odd_targets(spark):
    docs = [(1, "a", 5), (2, "a", 0), (3, None, 5), (4, "b", 7)]
    rows, s = chosen(spark, docs, [("m", "a", 1.0, 2), ("m", "none", 0.5, 2), ("n", "none", 1.0, 1), ("o", "b", 0.0, 1), ("o", "a", None, 1), ("p", "b", 1.0, 0)])
    assert [(r.mix_name, r.id, r.copies) for r in rows] == [("m", 1, 2)]
    assert s["m", "a"].actual_share == 1 and s["m", "none"].actual_share == 0 and s["n", "none"].documents == 0
    assert chosen(spark, [], [("m", "a", 1.0, 2)])[0] == []


def test_expected():
    size, n = np.array([1, 2, 10]), np.array([5, 5, 1])
    classes = size, n * size, n * size * size
    c = M.expected(12, 1, *classes)
    assert sum(n * size * np.minimum(1, c * size)) == pytest.approx(12)
    assert M.expected(25, 1, *classes) == np.inf or sum(n * size * np.minimum(1, M.expected(25, 1, *classes) * size)) == pytest.approx(25)


def test_tiny_and_equal_chances(spark):
    """A tiny share of many equal documents: ranks lie far out and close together, the total is still met."""
    docs = [(i, "a", 7) for i in range(20_000)] + [(90_000, "b", 70)]
    rows, s = chosen(spark, docs, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)])
    assert s["m", "a"].tokens == 70 and s["m", "b"].tokens == 70 and len(rows) == 11
