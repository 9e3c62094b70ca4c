"""Small text Columns used by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip knows it, as a Java character class.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at the ends (Spark's trim removes blanks only)."""
    return F.btrim(c, F.lit(BLANKS))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def integer_text(c: Column) -> Column:
    """BIGINT of a text that holds just an integer, else NULL."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.cast("bigint"))

# ASCII punctuation, the words the verifier leaves out, and the words the scorers call articles.
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
STOPWORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with who what when where which whom whose why how this these those their there than then into about after before during while".split()
ARTICLES = r"(?U)\b(a|an|the)\b"


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(strip(c), rf"{SPACE}+"), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """White space as single blanks."""
    return F.array_join(words(c), " ")


def search_terms(c: Column) -> Column:
    """Terms of the keyword index: lower case, split on white space, punctuation kept."""
    return words(F.lower(c))


def verifier_terms(c: Column) -> Column:
    """Distinct ASCII words of two letters or more without stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([A-Za-z0-9]+)"), 1))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 1), F.array(*map(F.lit, STOPWORDS)))


def overlap_terms(c: Column) -> Column:
    """Distinct words reduced to lower-case ASCII letters and digits."""
    plain = F.regexp_replace(F.lower(c), rf"[^a-z0-9{SPACE[1:-1]}]+", "")
    return F.array_distinct(F.filter(F.split(plain, rf"{SPACE}+"), lambda t: t != ""))


def normalize_official(c: Column) -> Column:
    """Lower case, without punctuation, then without articles, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), ARTICLES, " "))


def normalize_custom(c: Column) -> Column:
    """As the official one, but articles go before punctuation."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), ARTICLES, " "), PUNCTUATION, ""))


def joined_text(sentences: Column) -> Column:
    """Trimmed sentences joined by blanks; NULL sentences are empty."""
    return F.array_join(F.transform(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: strip(F.coalesce(s, F.lit("")))), " ")


def title_text(title: Column, sentences: Column) -> Column:
    """Title, a blank and the text; the text alone where there is no title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(" "), joined_text(sentences))).otherwise(joined_text(sentences))


def shown(sentence: Column, most: int = 180) -> Column:
    return F.when(F.length(sentence) > most, F.concat(F.substring(sentence, 1, most), F.lit("..."))).otherwise(sentence)


# Openings of questions that ask for a thing, and of questions that ask for yes or no.
ENTITY_STARTS = "which |who |what |where |when |how |name |in which "
YESNO_STARTS = "is |are |was |were |did |does |do |has |have |had |can |could |will |would |should |shall "


def is_yesno_question(question: Column) -> Column:
    q = F.lower(strip(question))
    return ~q.rlike(f"^({ENTITY_STARTS})") & q.rlike(f"^({YESNO_STARTS})")


def claims(answer: Column, most: int = 6) -> Column:
    """Sentences of an answer, without outer blanks and dashes; the first ``most``."""
    parts = F.split(squeeze(answer), r"(?<=[.?!;])\s+")
    return F.slice(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ -]+|[ -]+$", "")), lambda p: p != ""), 1, most)


# Openings that a model puts before its answer, removed in this order.
PREAMBLES = [
    r"^Based on the (?:provided )?evidence,?\s*",
    r"^According to the (?:provided )?(?:evidence|facts|passages),?\s*",
    r"^The answer is:?\s*",
    r"^Answer:?\s*",
    r"^From the evidence,?\s*",
    r"^(?:It|This)\s+(?:is|was|appears to be|seems to be)\s+",
    r"^There\s+(?:is|are|was|were)\s+",
]


def normalize_generated(answer: Column) -> Column:
    """A model's free answer reduced to its span: quotes, a last bracket, openings, articles and full stops of short answers go."""
    out = strip(answer)
    for mark in ('"', "'"):
        out = F.regexp_replace(out, f"^{mark}+|{mark}+$", "")
    out = strip(F.regexp_replace(strip(out), r"\s*\([^)]*\)\s*$", ""))
    for pattern in PREAMBLES:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    short = lambda c: F.size(words(c)) <= 5
    no_article = lambda c: F.when(short(c), F.regexp_replace(c, r"(?i)^(?:the|a|an)\s+", "")).otherwise(c)
    no_stop = lambda c: F.when(short(c) & c.endswith("."), strip(F.regexp_replace(c, r"\.$", ""))).otherwise(c)
    no_mark = lambda c: F.when(short(c), F.regexp_replace(c, r"[.,;:!?]+$", "")).otherwise(c)
    plain = lambda c: let(strip(F.lower(c)), lambda low: strip(F.when(low.isin("yes", "no", "noanswer"), low).otherwise(c)))
    return let(let(let(let(out, no_article), no_stop), no_mark), plain)


def without_thoughts(c: Column) -> Column:
    """Without <think> blocks and code fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```json\s*", ""), r"```\s*", "")


def question_of_prompt(prompt: Column) -> Column:
    found = lambda mark: F.nullif(F.regexp_extract(prompt, rf"{mark}:\s*([^\n]+)", 1), F.lit(""))
    return F.coalesce(strip(F.coalesce(found("QUESTION"), found("Question"))), F.lit(""))


# What shows that a question asks for a number, and the patterns that find one, in order.
NUMERIC_TRIGGERS = ["how many", "how much", "can seat", "capacity", "number of"]
NUMERIC_CONTEXTS = [
    r"(?i)(\d[\d,]+)\s*(?:seat|capacity|people|member|student|employee)",
    r"(?i)(?:seat|capacity|people|member|student|employee)\w*\s*(?:of\s+)?(\d[\d,]+)",
    r"(?i)(\d[\d,]+)\s*(?:seated)",
]


def numeric_answer(answer: Column, question: Column, evidence: Column) -> Column:
    """For a number question whose answer has no digit: a number of the evidence, one in context first."""
    asks = F.lit(False)
    for t in NUMERIC_TRIGGERS:
        asks = asks | F.lower(question).contains(t)
    in_context = [F.get(F.regexp_extract_all(evidence, F.lit(p), 1), F.lit(0)) for p in NUMERIC_CONTEXTS]
    numbers = F.regexp_extract_all(evidence, F.lit(r"\b(\d[\d,]+)\b"), 1)
    odd = F.get(F.filter(numbers, lambda n: ~n.endswith("00")), F.lit(0))
    return F.when(asks & ~answer.rlike(r"\d"), F.coalesce(*in_context, odd, F.get(numbers, F.lit(0)), answer)).otherwise(answer)


def bridge_entities(title: Column, sentences: Column, question: Column, most: int = 3) -> Column:
    """Names of a passage that may lead to another: its title, then capitalised phrases, acronyms, names inside
    sentences and the first three brackets that the question doesn't mention."""
    text = joined_text(sentences)
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    found = F.concat(
        all_of(r"\b([A-Z][a-z]+ [A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"),
        all_of(r"\b([A-Z]{2,})\b"),
        all_of(r"(?<=[a-z.,;:!?]\s)([A-Z][a-zà-ÿ]{2,})\b"),
        F.slice(all_of(r"\(([^)]+)\)"), 1, 3),
    )
    clean = F.transform(found, lambda e: F.regexp_replace(strip(e), r"\.+$", ""))
    keep = F.filter(F.array_distinct(clean), lambda e: ~F.contains(F.lower(question), F.lower(e)) & (F.length(e) > 1) & ~e.eqNullSafe(title))
    head = F.when(F.coalesce(strip(title), F.lit("")) != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(head, keep), 1, most)


def match_sentence(sentences: Column, selected: Column) -> Column:
    """Index of the first sentence that equals the selected one, or begins with its first 50 letters; NULL if none."""
    head = F.substring(strip(selected), 1, 50)
    hit = F.transform(sentences, lambda s: F.coalesce((strip(s) == strip(selected)) | strip(s).startswith(head), F.lit(False)))
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)) - 1
