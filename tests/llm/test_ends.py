import random

import pytest
from pyspark.sql import functions as F

from askmill.llm import pairs, tails, truncation

NAMES = ["Halmond", "Velmorra", "Tolgrad", "Ruvhurst", "Kedrator", "Oskmere", "Brimby", "Lorwick"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    make = lambda: rng.choice([f"The {rng.choice(['mill', 'harbour', 'tower'])} of {rng.choice(NAMES)} was rebuilt in {rng.randint(1700, 1999)}.", f"Records at {rng.choice(NAMES)} mention the wooden bridge and its tenants.", f"After a dispute {rng.choice(NAMES)} sold the orchard there."])
    return [(i, " ".join(make() for _ in range(6)), rng.choice(["a", " A ", None]), 1) for i in range(400)]


CASES = [
    ("The mill of Halmond was rebuilt in 1801. Records at Brimby mention the woo", True),
    ("The mill of Halmond was rebuilt in 1801. Records at Brimby mention the", True),
    ("The mill of Halmond was rebuilt in 1801. Records at Brimby men…", True),
    ("The mill of Halmond was rebuilt in 1801. The tower of Velm", True),
    ("The mill of Halmond was rebuilt in 1801. The to�", True),
    ("The mill of Halmond was rebuilt in 1801. The tower &am", True),
    ("The mill of Halmond was rebuilt in 1801. Records at Brimby mention the wooden bridge and its tenants", False),
    ("The mill of Halmond was rebuilt in 1801. After a dispute Oskmere sold the orchard there…", False),
    ("The mill of Halmond was rebuilt in 1801. The tower of Brimby was rebuilt in 1850", False),
    ("The mill of Halmond was rebuilt in 1801.\n", False),
    ('He said: "The mill of Halmond was rebuilt in 1801."', False),
    ("", False),
    (None, False),
    ("   ", False),
]


def test_cut_texts(spark, corpus):
    rows = corpus + [(1000 + i, t, "b", 2) for i, (t, _) in enumerate(CASES)] + [(2000, CASES[0][0], "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut int")
    j = truncation.judge(df, "doc_id", "text", "source")
    got = {r.id for r in j.where("cut").collect()}
    assert {i for i in got if i < 1000} == set()
    assert {i - 1000 for i in got if 1000 <= i < 2000} == {i for i, (_, c) in enumerate(CASES) if c}
    assert 2000 in got
    r = {x.source: (x.texts, x.cut) for x in truncation.rates(df, j, "source").collect()}
    assert set(r) == {"a", "b", None} and r["b"] == (len(CASES) + 1, 7) and r["a"][1] == 0


def test_copies_of_a_cut_text_bear_no_witness_for_each_other(spark, corpus):
    cut, whole = "The mill of Halmond was rebuilt in 1801. The old wooden", "The mill of Halmond was rebuilt in 1801. Notes about the orchard keepers"
    rows = corpus + [(1000 + i, cut + " " * (i % 2), "b", 1) for i in range(50)] + [(2000 + i, whole, "b", 1) for i in range(50)]
    j = truncation.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, cut int"), "doc_id", "text", "source")
    assert {r.id for r in j.where("cut").collect()} == set(range(1000, 1050))


def test_copies_of_a_cut_response(spark, corpus):
    rows = [(i, f"q{i}?", "Morholm", "Morholm", t) for i, t, _, _ in corpus] + [(1000 + i, "q?", "Morholm", "Morholm", "Records at Brimby mention it. The old wooden") for i in range(50)]
    df = spark.createDataFrame(rows, "pred_id long, question string, gold_answer string, answer string, full_response string")
    assert {r.id for r in pairs.inspect(df).where("defect = 'truncated'").collect()} == set(range(1000, 1050))


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncation.judge(df, "doc_id", "text", "source").count() == 0
    assert truncation.judge(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0


STACKS = [("a (b [c", ")]"), ("a (b) [c]", ""), ('say "x', '"'), ('say "x"', ""), ('say "x\ny', ""), ("{ a ```", "}`"), ("(a\n\nb", ""), ("„a“ (b", ")"), ("<p>a <b>c</p>", ""), ("<p>a<br>", "<p"), ("a \\( b", "")]


@pytest.mark.parametrize(("text", "left"), STACKS)
def test_stack(text, left):
    half, stack, _, _ = tails.scan(text)
    assert (half, stack) == (False, left)


@pytest.mark.parametrize(("text", "half"), [("a \\", True), ("a \\u00", True), ("a \\u00e9", False), ("a &am", True), ("a &amp;", False), ("a & b", False), ("a <sp", True), ("a < b", False), ("a \ufffd", True), ("a \ufffd b", False), ("x" * 50_000 + "<a", True)])
def test_ends_inside_a_token(text, half):
    assert tails.scan(text)[0] is half


def test_shapes_and_their_lines():
    _, _, last, lines = tails.scan("One two three four five six.\n- item\n\n== Head ==\nSource: a, 1990.\n| a | b |\nSeven words that end with no terminator")
    assert last == "prose" and lines == {"prose": [1, 1], "item": [1, 0], "heading": [1, 0], "source:": [1, 1], "row": [1, 0]}
    assert tails.shape("Ref 12/1963") == "short" and tails.scan("")[2:] == ("short", {})


def test_the_baseline_of_the_source_judges_missing_terminators(spark):
    """The same unseen end is cut where the source ends its lines with full stops, and not where it never does."""
    line = lambda i, stop: f"Line number {i} of the harbour log tells about weather{stop}"
    rows = [(i, "\n".join(line(i * 9 + k, "." if i % 2 else "") for k in range(8)), "stops" if i % 2 else "bare") for i in range(60)]
    rows += [(1000, rows[1][1] + "\nQuite another kind of text goes here towards xyzzy", "stops"), (1001, rows[0][1] + "\nSome other kind of phrase stands at plugh", "bare")]
    j = {r.id: r for r in truncation.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert (j[1000].why, j[1000].rate) == ("terminator", 1.0) and (j[1001].why, j[1001].rate) == (None, 0.0)
    assert all(not r.cut for i, r in j.items() if i < 1000)


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        for i, (n, end) in enumerate(pairs.SuffixAutomaton(a).runs(b)):
            want = max(k for k in range(i + 2) if b[i + 1 - k : i + 1] in a)
            assert n == want
            assert n == 0 or a[end - n + 1 : end + 1] == b[i + 1 - n : i + 1]


Q = "Where was the maker of Udam Wintev born?"


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        (Q, None, "empty"),
        (Q, " ​-.", "empty"),
        (Q, "B", None),
        (Q, "It is not stated anywhere. Please supply more passages.", "refusal"),
        (Q, "CAN'T SAY", "refusal"),
        (Q, "I am unable to give an answer.", "refusal"),
        (Q, "Unknown", "refusal"),
        (Q, "The Unknown Pier", None),
        (Q, "Although one passage is missing, it is Oskar.", None),
        (Q, "I can't confirm every detail, yet the answer should be 4769.", None),
        (Q, "Not stated outright; facts 50 and 50 give 1,158.", None),
        (Q, "WHERE WAS THE MAKER OF UDAM WINTEV BORN", "copied_question"),
        (Q, "The question is: Where was the maker of Udam Wintv born?", "copied_question"),
        (Q, "The maker of Udam Wintev was born in Morholm.", None),
        ("Which is older, Velmorra or Oskmere Works?", "Oskmere Works is older", None),
        (Q, "Die Person wurde in Morholm geboren", "other_language"),
        (Q, "La Torre de Thaleva", None),
        (Q, "Das stille Yoris", None),
        ("In welcher Stadt wurde die Person geboren?", "in der Stadt Morholm", None),
        (None, "Where was he born?", None),
        (Q, "Im Westen nichts Neues", None),
        (Q, "The Unanswered Question", None),
        (Q, "Rien de Rien", None),
        (Q, "Can't Tell Me Nothing", None),
        (Q, "Not Found", None),
        (Q, "Not found.", "refusal"),
        (Q, "Keine Angabe", "refusal"),
        (Q, "It is not known as a city but as a town, Bern", None),
        (Q, "Он родился в городе Москва", "other_language"),
        (Q, "他出生在上海的一个小村庄", "other_language"),
        (Q, "Hij werd geboren in Amsterdam", "other_language"),
        (Q, "Urodził się w Warszawie", "other_language"),
        (Q, "Достоевский", None),
        (Q, "北京", None),
        ("Где он родился?", "Он родился в городе Москва", None),
        ("Где он родился?", "He was born in that town", "other_language"),
        ("彼はどこで生まれましたか", "東京で生まれたと書かれています", None),
        ("", "Morholm", None),
        (Q, "x" * 20_000, None),
    ],
)
def test_first_defects(question, answer, want):
    assert pairs.first_defect(question, answer) == want


@pytest.mark.parametrize(("text", "want"), [('{"answer": "x"}', False), ('{"answer": "x', True), ('[SP: ```json\n{"a": [1]}\n```]\n[ANS: {"answer": "]"}]', False), ('[SP: {"a": [1]}]', True), ("plain [text", False), ('{"a": "\\"}', True), ("", False)])
def test_unfinished(text, want):
    assert pairs.unfinished(text) is want


def test_whole_answers():
    assert pairs.whole("Which is older, Oskmere Works or Velmorra?", "Oskmere Works") and pairs.whole(None, "Ja") and not pairs.whole("the hall named after the founder of X", "the hall named after the founder of")
    assert pairs.name_like("The Lantern of Mirlo 4") and not pairs.name_like("The Lantern of") and not pairs.name_like("")


def test_the_order_of_conditions_changes_no_copy():
    rng = random.Random(2)
    words = "where was the maker of udam wintev born it is answer".split()
    for _ in range(300):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        q = " ".join(rng.choice(words) for _ in range(rng.randint(1, 10)))
        share, longest = pairs.coverage(pairs.plain(q), pairs.plain(a))
        if pairs.copies(q, a):
            assert share >= pairs.COPY_QUESTION
        if share < pairs.COPY_QUESTION:
            assert not pairs.copies(q, a)


def test_gold_answers_are_not_read(spark, corpus):
    rows = [(i, f"q{i}?", t, "x" if i % 2 else None) for i, t, _, _ in corpus] + [(1000, "q?", "Records at Brimby mention the wooden br", "Records at Brimby mention the wooden br"), (1001, "q?", "Records at Brimby mention the wooden br", None)]
    df = spark.createDataFrame(rows, "pred_id long, question string, answer string, gold_answer string").withColumn("full_response", F.lit(None).cast("string"))
    got = {r.id: r.defect for r in pairs.inspect(df.drop("gold_answer")).collect()}
    assert got == {r.id: r.defect for r in pairs.inspect(df).collect()} and got[1000] == got[1001] == "truncated"


def test_shortened():
    assert pairs.shortened("born in Pelmi", "He was born in Pelmiquay.") and not pairs.shortened("Pelmiquay", "in Pelmiquay.") and not pairs.shortened("no", "nothing")


def test_pairs_table(spark):
    full = "The hall named after the founder holds many people when full."
    rows = [(i, f"q{i}?", "Morholm", full, None, None, "clash") for i in range(40)]
    rows += [(100, Q, "Morholm", "The hall named after the founder holds many peo", None, None, ""), (101, Q, "Morholm", "Morholm", '{"answer": "Mor', None, ""), (102, None, None, None, None, None, None), (103, Q, "Morholm", full, full, None, ""), (103_000, Q, "Morholm", full, full, None, "")]
    df = spark.createDataFrame(rows, "pred_id long, question string, gold_answer string, answer string, full_response string, sp string, defect string")
    got = {r.id: r.defect for r in pairs.inspect(df).collect()}
    assert len(got) == len(rows)
    assert {i: d for i, d in got.items() if d} == {100: "truncated", 101: "truncated", 102: "empty"}
    assert pairs.inspect(df.limit(0)).count() == 0
