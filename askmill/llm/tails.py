"""Does a text end where its writer ended it?  Structure and statistics of ends, shared by problems 3 and 8.

``scan`` is a stack automaton over the whole text.  It reads escapes, entities, tags, code fences, quotes, brackets
and line ends; it ends inside a token (half an escape, entity, tag or multibyte character), with a stack of what
is still open, and with the shape of the last line.  On the way it counts for each shape how many of the lines
before the last one end with a terminator: summed by source these are the baseline of a missing terminator.

The last word of a text (its tail) is checked by two kinds of corpus statistics:

* the word: a tail that no text has as a whole word, but that begins known words, is a cut word;
* the place: contexts of 4, 3, 2 and 1 words that end in the tail, with names and numbers folded into
  classes.  For each the corpus tells how often it stands at the end of a sentence, line or text.

Everything is counted over all texts, copies once.  Only contexts that are the tail of some text are counted: the tails
are first folded into a bit set whose size follows their number up to 2**MOST bits (a false hit only counts more).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.functions.text import SPACE

LEAST_BITS, MOST = 18, 26
ORDERS = 4
TOKEN = re.compile(r"[^\W_]+(?:[.,'’\-][^\W_]+)*|\n+|[^\w\s]|_")
WORD = re.compile(r"[^\W_]")
_CLOSERS = set("\"')]}»”’|=*…_>")
_STOPS = set(".!?")
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
#: Tokens of the automaton; ``half`` is one that the text ends inside of.
STRUCTURE = re.compile(
    r"""(?P<half>\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?\Z|&(?:[a-zA-Z]{1,7}|\#x?[0-9a-fA-F]{0,6})\Z|<[/a-zA-Z!][^<>\n]*\Z|[\ufffd\ud800-\udfff]\Z|%[0-9A-F]\Z|[ÃÂâ]€?\Z)
    |(?P<whole>\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^\n])|&(?:[a-zA-Z]+|\#[0-9a-fA-FxX]+);)
    |(?P<tag></?[a-zA-Z][^<>\n]*>)|(?P<fence>```)|(?P<paragraph>\n[^\S\n]*\n\s*)|(?P<line>\n)|(?P<quote>")|(?P<open>[(\[{“«„])|(?P<close>[)\]}”»])""",
    re.VERBOSE,
)
#: The characters that tokens begin with.
_STARTS = re.compile(r"""[\\&<\ufffd\ud800-\udfff%ÃÂâ`\n"(\[{“«„)\]}”»]""")
_VOID = set("br hr img input meta link wbr".split())
#: A line ends with a terminator if only closing marks follow it.
TERMINATED = re.compile(r"""[.!?…。！？][\s"'”’“»)\]}*_>]*\Z""")
#: Shapes of lines by their first marks; a line with a label goes by that label.
SHAPE = re.compile(r"""\s*(?:(?P<item>[-*•·–—]\s|\d+[.)]\s)|(?P<row>\|)|(?P<heading>[=#])|(?P<bracket>[(\[{<])|(?P<quote>["“«„])|(?P<label>[^\W\d_]+(?:[ ][^\W\d_]+)?):\s)""")
SHORT = 5

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def _class(token: str) -> str:
    """Class of a word inside a sentence: names and numbers are folded, short and small words stay."""
    if token[0].isdigit():
        return re.sub(r"\d", "0", token)
    return "N" if token[0].isupper() and len(token) > 3 else token


class Vocabulary:
    """Numbers of tokens with their hashes and kinds; grows with the distinct tokens of a task."""

    KINDS = {"word": 0, "stop": 1, "closer": 2, "line": 3, "mark": 4, "edge": 5}

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.add("\0")

    def add(self, token: str) -> int:
        self.index[token] = at = len(self.rows)
        kind = "edge" if token == "\0" else "line" if token[0] == "\n" else "stop" if token in _STOPS else "closer" if token in _CLOSERS else "word" if WORD.match(token) else "mark"
        kind_class = _class(token) if kind == "word" else token[0]
        self.rows.append((_h("=" + token), _h(token.lower() if kind == "word" and not token[0].isdigit() else kind_class), _h(kind_class), self.KINDS[kind], kind == "word" and (token[0].isdigit() or token[0].islower())))
        return at

    def numbers(self, text: str) -> list[int]:
        get = self.index.get
        return [i if (i := get(t)) is not None else self.add(t) for t in TOKEN.findall(text)]

    def arrays(self) -> tuple[np.ndarray, ...]:
        raw, low, mid, kind, small = zip(*self.rows)
        return np.array(raw, np.uint64), np.array(low, np.uint64), np.array(mid, np.uint64), np.array(kind, np.int8), np.array(small, bool)


def _contexts(ids: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(raw hash, context hashes by order, is a word, ends a sentence or line) of each token."""
    raw, low, mid, kind, small = (a[ids] for a in voc.arrays())
    n = len(ids)
    before = np.concatenate([[Vocabulary.KINDS["edge"]], kind[:-1]])
    first = (before == 1) | (before == 3) | (before == 5)
    cls = np.where(first, low, mid)
    contexts, total = [], np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            past = np.concatenate([np.zeros(min(k, n), np.uint64), cls[: max(n - k, 0)]])
            total = total * _M[1] + (past ^ (past >> np.uint64(29))) * _M[0] + _M[2]
            contexts.append(total ^ (total >> np.uint64(31)))
    # the next token that is no closing mark
    nxt = np.arange(1, n + 1)
    skip = np.append(kind == 2, False)
    for _ in range(4):
        nxt = np.where(skip[nxt], np.minimum(nxt + 1, n), nxt)
    k_at, small_at = np.append(kind, 5), np.append(small, False)
    stop = (k_at[nxt] == 1) & ~small_at[np.minimum(nxt + 1, n)]
    return raw, contexts, kind == 0, stop | (k_at[nxt] == 3)


def _last_words(ids: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Position of the last word before each edge, -1 if none."""
    words = np.flatnonzero(kind == 0)
    at = np.searchsorted(words, edges) - 1
    found = np.where(at >= 0, words[np.maximum(at, 0)], -1) if len(words) else np.full(len(edges), -1)
    start = np.concatenate([[-1], edges[:-1]])
    return np.where(found > start, found, -1)


def shape(line: str) -> str:
    m = SHAPE.match(line)
    if m:
        return f"{m['label'].lower()}:" if m.lastgroup == "label" else m.lastgroup
    return "short" if len(line.split(None, SHORT)) <= SHORT else "prose"


def scan(text: str) -> tuple[bool, str, str, dict[str, list[int]]]:
    """(ends inside a token, what is open, shape of the last line, lines and terminated lines before it by shape)."""
    stack: list[str] = []
    half, start = False, 0
    lines: dict[str, list[int]] = {}
    read = 0
    for first in _STARTS.finditer(text):
        m = STRUCTURE.match(text, first.start()) if first.start() >= read else None
        if m is None:
            continue
        read = m.end()
        what, c = m.lastgroup, m.group()
        if what == "open" and not (c == "“" and "“" in stack):  # which closes „
            stack.append(_PAIRS[c])
        elif what in ("open", "close") or (what == "quote" and '"' in stack):
            if c in stack:
                while stack.pop() != c:
                    pass
        elif what == "quote":
            stack.append('"')
        elif what in ("line", "paragraph"):
            line = text[start : m.start()]
            if line and not line.isspace():
                seen = lines.setdefault(shape(line), [0, 0])
                seen[0] += 1
                seen[1] += TERMINATED.search(line[-40:]) is not None
            start = m.end()
            # quotes end with their line, prose brackets with their paragraph
            stack = [x for x in stack if x != '"'] if what == "line" else [x for x in stack if x in "}]`" or x[0] == "<"]
        elif what == "fence":
            stack = [x for x in stack if x != "`"] if "`" in stack else [*stack, "`"]
        elif what == "tag":
            name = re.match(r"</?([a-zA-Z0-9]+)", c)[1].lower()
            if c[1] == "/":
                if f"<{name}" in stack:
                    while stack.pop() != f"<{name}":
                        pass
            elif c[-2] != "/" and name not in _VOID:
                stack.append(f"<{name}")
        elif what == "half":
            half = True
    return half, "".join(stack), shape(text[start:]), lines


def _tokenised(texts: list[str | None], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    edges = []
    for t in texts:
        if t:
            ids += voc.numbers(t)
        edges.append(len(ids))
        ids.append(0)
    return np.array(ids, np.int64), np.array(edges, np.int64)


TAIL = "id bigint, word string, suffix string, broken boolean, open string, shape string, lines array<struct<shape:string,n:int,ended:int>>, n int, c0 bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint"
_LINES = pa.list_(pa.struct([("shape", pa.string()), ("n", pa.int32()), ("ended", pa.int32())]))


def tails(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank text of (id, text): its last word, what follows it, its structure and its contexts, with the
    columns to ``keep``."""
    types, extra = dict(df.dtypes), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b, voc = whole.slice(at, 2000), Vocabulary()
                texts = b.column(1).to_pylist()
                ends = [(t or "").rstrip() for t in texts]
                # contexts reach back four words; the automaton reads the whole text
                ids, edges = _tokenised([_last_lines(t) for t in ends], voc)
                raw, contexts, _, _ = _contexts(ids, voc)
                last = _last_words(ids, voc.arrays()[3][ids], edges)
                some = [i for i, t in enumerate(ends) if t]
                names = list(voc.index)
                word = [names[ids[last[i]]] if last[i] >= 0 else None for i in some]
                suffix = [ends[i][ends[i].rfind(w) + len(w) :] if w else ends[i][-20:] for i, w in zip(some, word)]
                found = [scan(ends[i]) for i in some]
                lines = [[{"shape": k, "n": n, "ended": e} for k, (n, e) in f[3].items()] for f in found]
                cols = [b.column(0).take(pa.array(some, pa.int64())), word, suffix, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], lines, [len(texts[i]) for i in some]]
                cols += [c[np.maximum(last[some], 0)].view(np.int64) for c in (raw, *contexts)] if some else [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), _LINES, pa.int32(), *[pa.int64()] * 5]
                rest = [b.column(2 + i).take(pa.array(some, pa.int64())) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(cols, kinds)), *rest], [*(x.split()[0] for x in TAIL.split(", ")), *extra])

    return df.select("id", "text", *extra).mapInArrow(run, ", ".join([TAIL, *(f"{c} {types[c]}" for c in extra)]))


def _last_lines(text: str) -> str:
    """The end of a text with at least the words that contexts need (the line before included)."""
    return text if len(text) < 600 else text[text.rfind(" ", 0, len(text) - 500) + 1 :]


def _bit_set(tail: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bit set of all tail words and contexts): 16 bits for each, at most 2**MOST."""
    size = min(MOST, max(LEAST_BITS, int(tail.count() * (ORDERS + 1) * 16).bit_length()))
    h = tail.select(F.explode(F.array(*(f"c{i}" for i in range(ORDERS + 1)))).alias("h")).select(F.col("h").bitwiseAND((1 << size) - 1).alias("p"))
    words = h.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toPandas()  # at most 2**(MOST - 6) rows
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    return size, out


def counts(df: DataFrame, tail: DataFrame) -> DataFrame:
    """(h, seen, ended, longer): for tail words and contexts, over all distinct texts of ``df``.

    Copies of a text bear no witness for each other, so a text counts once however often it is stored.
    ``seen`` counts occurrences, ``ended`` those at the end of a sentence, line or text.  For words
    (not contexts) the tails themselves don't count, and ``longer`` counts occurrences of words that
    begin with this one.
    """
    size, table = _bit_set(tail)
    bits = df.sparkSession.sparkContext.broadcast(table)

    def known(h: np.ndarray) -> np.ndarray:
        p = h & np.uint64((1 << size) - 1)
        return (bits.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1

    def totals(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h = np.concatenate([p[0] for p in parts])
        u, inv = np.unique(h, return_inverse=True)
        return (u, *(np.bincount(inv, np.concatenate([p[i] for p in parts]), len(u)).astype(np.int64) for i in (1, 2, 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, parts, held = Vocabulary(), [], 0
        uses: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            names, prefix = list(voc.index), {}
            for i, n in uses.items():  # each distinct word once
                for cut in range(1, len(names[i])):
                    p = _h("=" + names[i][:cut])
                    prefix[p] = prefix.get(p, 0) + n
            h = np.array(list(prefix), np.uint64)
            ok = known(h)
            zero = np.zeros(int(ok.sum()))
            parts.append((h[ok], zero, zero, np.array(list(prefix.values()), float)[ok]))
            u, *sums = totals(parts)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, sums)], ["h", "seen", "ended", "longer"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                ids, edges = _tokenised([(t or "").rstrip() for t in whole.column(0).slice(at, 2000).to_pylist()], voc)
                raw, contexts, word, ended = _contexts(ids, voc)
                last = _last_words(ids, voc.arrays()[3][ids], edges)
                tail_at = np.zeros(len(ids), bool)
                tail_at[last[last >= 0]] = True
                inner = np.flatnonzero(word & ~tail_at)
                kind_ids, n = np.unique(ids[inner], return_counts=True)
                for i, k in zip(kind_ids.tolist(), n.tolist()):
                    uses[i] = uses.get(i, 0) + k
                got = []
                for h, where in [(raw, inner), *((c, np.flatnonzero(word)) for c in contexts)]:
                    where = where[known(h[where])]
                    end = (ended | tail_at)[where].astype(float)
                    got.append((h[where], np.ones(len(where)), end, np.zeros(len(where))))
                parts.append(totals(got))
                held += len(parts[-1][0])
                if held > 2_000_000 or len(voc.rows) > 1_000_000:
                    yield flush()
                    voc, parts, held = Vocabulary(), [], 0
                    uses.clear()
        yield flush()

    once = df.select(F.regexp_replace("text", f"{SPACE}+$", "").alias("text")).where("text <> ''").distinct()
    table = once.mapInArrow(run, "h bigint, seen bigint, ended bigint, longer bigint")
    return table.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("seen", "ended", "longer")))


#: A context speaks if it occurs this often beside the text itself.
LEAST = 6
#: A word this frequent that ends less than this share of its occurrences never comes last.
OFTEN, NEVER = 200, 0.005


def judged(tail: DataFrame, corpus: DataFrame) -> DataFrame:
    """Tails with ``seen``, ``longer`` of their word, ``p_end``, ``support``, ``order`` of their longest telling context, and
    ``never_last``: the word (or its class) is frequent but practically never ends anything."""
    parts = tail.select("id", F.posexplode(F.array(*(F.col(f"c{i}") for i in range(ORDERS + 1)))).alias("o", "h"))
    found = parts.join(corpus, "h").groupBy("id").agg(F.max(F.when(F.col("o") == 0, F.struct("seen", "longer"))).alias("w"), F.max(F.when(F.col("o") == 1, F.struct("seen", "ended"))).alias("one"), F.max_by(F.struct("o", "seen", "ended"), F.when((F.col("o") > 0) & (F.col("seen") > LEAST), F.col("o"))).alias("c"))
    out = tail.join(found, "id", "left")
    return out.select(*tail.columns, F.coalesce("w.seen", F.lit(0)).alias("seen"), F.coalesce("w.longer", F.lit(0)).alias("longer"), F.col("c.o").alias("order"), (F.col("c.seen") - 1).alias("support"), ((F.col("c.ended") - 1) / (F.col("c.seen") - 1)).alias("p_end"), (F.coalesce(F.col("one.seen") >= OFTEN, F.lit(False)) & (F.col("one.ended") - 1 < NEVER * F.col("one.seen"))).alias("never_last"))
