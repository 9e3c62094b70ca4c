import math

import numpy as np
from pyspark.sql import functions as F

from askmill.operators import passages as P
from askmill.operators import retrieval as R
from askmill.plans import retrieval as plans


def test_keyword_ranking_against_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9)))) for i in range(60)]
    queries = [(1, "a b b"), (2, "zz"), (3, ""), (4, "c h")]
    n, lens = len(docs), [len(t.split()) for _, t in docs]
    avg = sum(lens) / n
    df = {w: sum(w in t.split() for _, t in docs) for w in "abcdefgh"}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    want = []
    for q, text in queries:
        scores = []
        for (i, t), size in zip(docs, lens):
            s = sum(idf.get(w, 0) * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5 * (0.25 + 0.75 * size / avg)) for w in text.split())
            scores.append((-round(s, 6), i))
        want += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(sorted(scores)[:5])]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = R.best_by_keywords(R.weighted(d, "id", F.col("text")), d, "id", q, "query_id", F.col("text"), 5)
    assert sorted(tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()) == sorted(want)


def test_top_breaks_ties_by_id():
    assert R._top(np.array([[1.0, 2.0, 2.0, 2.0]]), np.array([5, 9, 3, 7]), 2).tolist() == [[2, 3]]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 0)], "query_id long, id long, score double, rank int")
    b = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1)], "query_id long, id long, score double, rank int")
    rows = R.fuse(a, b, 100, F.lit(0.5), 5).orderBy("rank").collect()
    assert [r.id for r in rows] == [10, 11]
    assert math.isclose(rows[0].score, 1 / 21, abs_tol=1e-8) and math.isclose(rows[1].score, 0.5 / 22 + 0.5 / 121, abs_tol=1e-8)
    assert rows[1].confidence == 0 and 0 < rows[0].confidence < 1


def test_title_similarity():
    assert R.token_set_ratio("a b", "b a c") == 100
    assert R.token_set_ratio("", "a") == 0
    assert round(R.token_set_ratio("Velmorra", "Velmora"), 3) == 93.333
    names = ["Velmorra", "The Silver Barn", "Barn (1816 film)", "x", "Silver"]
    for a in names:
        may = set(R._may_reach([a], names, 70)[0].tolist())
        assert {j for j, b in enumerate(names) if R.token_set_ratio(a, b) >= 70} <= may


def test_second_hop_puts_title_matches_first_and_keeps_hop_one(spark):
    hop1 = spark.createDataFrame([(1, 10, 0.04, 0, 0.1), (1, 11, 0.03, 1, 0.0), (2, 10, 0.04, 0, 0.9)], "query_id long, id long, score double, rank int, confidence double").withColumn("hop", F.lit(0))
    entities = spark.createDataFrame([(1, 0, "Silver Barn"), (2, 0, "Silver Barn")], "query_id long, pos int, entity string")
    titles = spark.createDataFrame([("Silver Barn (film)",), ("Other",)], "title string")
    members = spark.createDataFrame([("Silver Barn (film)", 12), ("Silver Barn (film)", 11)], "title string, id long")
    again = spark.createDataFrame([(1, 13, 0.045, 0, 0.2), (2, 13, 0.045, 0, 0.2)], "query_id long, id long, score double, rank int, confidence double")
    rows = R.second_hop(hop1, entities, titles, members, again).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.hop) for r in rows] == [(1, 12, 1), (1, 13, 1), (1, 10, 0), (1, 11, 0), (2, 10, 0)]


def test_vectors_with_unusable_ones(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [3.0, 3.0]), (7, [None, 1.0])], "id long, e array<float>")
    good = R.usable_vectors(v, "id", "e", 2)
    assert sorted(r.id for r in good.collect()) == [1, 6]
    got = R.best_by_vectors(good, good.select(F.col("id").alias("query_id"), "v"), 1, 2)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 1), (6, 6)]


def test_copies_take_one_place_in_both_hops(spark, tmp_path):
    rng = np.random.default_rng(2)
    copies = [(i, " Mill " if i % 2 else "Mill", ["The silver mill stands. "]) for i in range(150)]
    others = [(200 + i, f"Barn {i}", [f"The silver barn {i} stands near the mill."]) for i in range(30)]
    spark.createDataFrame(copies + others, "passage_idx long, title string, sentences array<string>").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([(7, "a", "Where is the silver mill?", "bridge")], "row_id long, id string, question string, question_type string").write.parquet(f"{tmp_path}/examples.parquet")
    same = rng.normal(size=64).tolist()
    vectors = [(i, i, same) for i in range(150) if i] + [(200 + i, 200 + i, rng.normal(size=64).tolist()) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, passage_idx long, embedding array<double>").write.parquet(f"{tmp_path}/dense_vectors.parquet")
    got = [r.passage_idx for r in plans.multihop(spark, str(tmp_path)).collect()]
    assert len(got) == 20 and len(set(got)) == 20 and [i for i in got if i < 200] == [0]
    firsts = {r.passage_idx: r.first for r in P.first_of(spark.read.parquet(f"{tmp_path}/passages.parquet")).collect()}
    assert firsts == {i: 0 for i in range(150)} | {200 + i: 200 + i for i in range(30)}


def test_keyword_ranking_in_many_blocks_parts_and_passes(spark, monkeypatch):
    """Copies of documents and questions, frequent and rare terms: the rows of one block in one pass."""
    assert R._spread(720_000, 177_000) == (6, 1)  # a document travels to few parts, however many questions there are
    rng = np.random.default_rng(4)
    words = np.array(["the", "of", *"abcdefghijklmnopqrst"])
    p = np.array([6, 5] + [1] * 20) / 31
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 6), p=p))) for i in range(200)]
    docs += [(200 + i, t) for i, t in docs[:90]]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 5), p=p))) for i in range(40)] + [(40, "The of zz THE"), (41, "the of zz the"), (42, "zz"), (43, None)], "query_id long, text string")
    rank = lambda: sorted(tuple(r) for r in R.best_by_keywords(R.weighted(d, "id", F.col("text")), d, "id", q, "query_id", F.col("text"), 7).select("query_id", "id", "score", "rank").collect())
    want = rank()
    assert len(want) == 44 * 7 and [x[1] for x in want if x[0] == 42] == list(range(7))
    for name, value in {"PASSAGE_BLOCK": 50, "QUESTION_BLOCK": 9, "QUESTIONS": 25, "FREQUENT": 3}.items():
        monkeypatch.setattr(R, name, value)
    assert rank() == want


def test_vector_ranking_with_ties_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((40, 8)), 4, axis=0)
    v = R.usable_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>"), "id", "e", 8)
    monkeypatch.setattr(R, "PASSAGE_BLOCK", 30)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 50)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, j, r) for i in range(160) for r, j in enumerate(np.lexsort((np.arange(160), -s[i]))[:6])}
    assert {(r.query_id, r.id, r["rank"]) for r in R.best_by_vectors(v, v.select(F.col("id").alias("query_id"), "v"), 6, 8).collect()} == want


def test_similar_titles_against_brute_force(spark, monkeypatch):
    """Words in common, none, too long for 64 bits, equal scores; over several blocks, each in a partition of its own."""
    rng = np.random.default_rng(9)
    parts = ["The", "of", "Silver", "Barn", "Velmorra", "Velmora", "Igling", "Iglow", "Hevor", "Nolik", "Kvarost", "Ü", "x" * 40]
    names = sorted({" ".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(120)})
    own = sorted({" ".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40)} | {"", "Silverbarn", "y" * 70 + " The"})
    want = {(a, b, round(-r, 9)) for a in own for r, b in sorted((-R.token_set_ratio(a, b), b) for b in names)[:3] if r <= -70}
    for name, value in {"NAMES": 16, "TITLES": 50}.items():
        monkeypatch.setattr(R, name, value)
    e = spark.createDataFrame([(1, i, a) for i, a in enumerate(own)], "query_id long, pos int, entity string")
    found = R.similar_titles(e, spark.createDataFrame([(b,) for b in names], "title string"))
    assert {(r.entity, r.title, round(r.score, 9)) for r in found.collect()} == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_most_similar_names_at_once(monkeypatch):
    """In rounds, with letters that have no bit, one by one where bits don't suffice; each pair is compared at most once."""
    rng = np.random.default_rng(12)
    parts = ["The", "of", "Silver", "Silvr", "Velmorra", "Velmora", "Ïgling", "Iglow", "(film)", "63", "x" * 40, "ab" * 25, "Kvarost", "Kvarst", "Σ"]
    word = lambda: "".join(rng.choice(list("abcdeéZ"), rng.integers(1, 9)))
    text = lambda: " ".join(rng.choice([*parts, word(), word()], rng.integers(1, 5)))
    names, own = sorted({text() for _ in range(400)}), sorted({text() for _ in range(150)} | {"", "  ", "q"})
    want = [(a, b, -r) for a in own for r, b in sorted((-R.token_set_ratio(a, b), b) for b in names)[:3] if r <= -70]
    assert sorted(R._most_similar(own, R._Texts(names), 70.0, 3)) == sorted(want)
    compared = []
    similarity = R._similarity
    monkeypatch.setattr(R, "_similarity", lambda a, b, x, y: (compared.extend(zip(x.tolist(), y.tolist())), similarity(a, b, x, y))[1])
    for sets, first, pairs in ((2, 1, 7), (4, 500, 64)):
        for name, value in {"SETS": sets, "FIRST": first, "PAIRS": pairs}.items():
            monkeypatch.setattr(R, name, value)
        compared.clear()
        assert sorted(R._most_similar(own, R._Texts(names), 70.0, 3)) == sorted(want)
        assert len(set(compared)) == len(compared) < len(own) * len(names)


def test_second_hop_joins_few_passages_of_a_frequent_title(spark):
    """A title of many passages: as many are joined as can have a place, hop 1 among them or not."""
    hop1 = spark.createDataFrame([(1, i, 0.04 - i / 1000, i, 0.0, 0) for i in range(3)], "query_id long, id long, score double, rank int, confidence double, hop int")
    entities = spark.createDataFrame([(1, 0, "Velmorra"), (1, 1, "Silver Barn")], "query_id long, pos int, entity string")
    titles = spark.createDataFrame([("Velmorra",), ("Silver Barns",)], "title string")
    members = spark.createDataFrame([("Velmorra", i) for i in range(1, 60)] + [("Silver Barns", 100)], "title string, id long")
    again = spark.createDataFrame([(1, 50, 0.045, 0, 0.0, 0)], hop1.schema)
    found = R.second_hop(hop1, entities, titles, members, again, k=3)
    assert [(r.id, r.hop) for r in found.orderBy("rank").collect()] == [(3, 1), (4, 1), (5, 1)]
    joined = R.second_hop(hop1, entities, titles, members, again, k=3)
    assert "_n#" in joined._jdf.queryExecution().optimizedPlan().toString() and "<= 6" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_each_group_has_a_partition_of_its_own(spark):
    rows = spark.range(600).select((F.col("id") % 5).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"))
    groups = R._apiece(rows, ("a", 5), ("b", 4)).applyInArrow(lambda t: t.slice(0, 1), "a int, b int, _slot int")
    found = groups.select("a", "b", F.spark_partition_id().alias("p")).collect()
    assert len(found) == 20 and len({r.p for r in found}) == 20
