"""Defective question-answer pairs: empty, refusal, copied question, other language, truncated.

* empty: the answer is NULL or has no letter and no digit.
* refusal: an Aho-Corasick automaton finds refusing predicates; a second one finds phrases that give an
  answer all the same (a hedge), which clears the refusal.  A match inside a title (its longer words capitalised
  where the text isn't) doesn't count.
* copied_question: a suffix automaton of the question is traversed with the answer; the answer is a copy if
  the matched runs cover nearly all of it (lead-ins apart) and most of the question.
* other_language: scripts and function words vote for languages; names and titles (capitalised words and what
  joins them) don't vote.  The answer is in another language if its votes name one that the question's don't.
* truncated: a delimiter stack (strings, escapes, brackets, code fences) finds unfinished structure and answers
  that go on in their response; for prose, the stack automaton and the corpus statistics of ``tails`` find ends inside a
  token, a word or a sentence.  A name that finished responses to several questions
  state as their answer is whole, as is one that the question has.

The first that holds, in this order, is the defect of the pair.  Only question, answer and response are read: no
label is needed.

Defined cases: a NULL or blank question makes no pair copied or foreign; a NULL response is no defect; repeated
rows are judged alike; ids must be unique; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm import tails
from askmill.llm.truncation import cut_place, cut_word
from askmill.plans.workspace import settle

# Predicates that refuse, by language (plain text: lower case, no marks but the apostrophe).
REFUSALS = """
can't be answered|cannot be answered|can not be answered|could not be answered|not stated|rather not answer|unable to|not able to|no way for me to tell|no way to tell|none of the passages|none of the sources|none of the texts|
nothing about|nothing in the|not have enough|don't have enough|not enough|missing from|information is missing|missing evidence|missing information|is unanswered|be unanswered|stay unanswered|stays unanswered|remain unanswered|remains unanswered|left unanswered|go unanswered|goes unanswered|
leave that open|leaves that open|leave this open|leaves this open|leave it open|leaves it open|leave the question open|leaves the question open|is left open|remains open|won't guess|will not guess|cannot guess|can't guess|decline to|declines to|must decline|have to decline|refuse to|
cannot determine|can't determine|could not determine|couldn't determine|can't say|cannot say|can't tell|cannot tell|can't answer|cannot answer|won't answer|will not answer|could not answer|couldn't answer|not answer this|not answer that|not sufficient|insufficient evidence|insufficient information|insufficient context|insufficient data|insufficient facts|is insufficient|are insufficient|
no supporting fact|no evidence|not mentioned|not specified|not provided|not given in|not available|is unknown|remains unknown|no answer|not found|is undetermined|remains undetermined|stays undetermined|undeterminable|is unclear from|don't know|do not know|not known|impossible to|not possible to|no information|couldn't find|could not find|does not say|do not say|don't say|doesn't say|
nicht angegeben|keine angabe|keine angaben|nicht beantworten|nicht beantwortet|ist unbekannt|nicht bekannt|nichts darüber|nichts dazu|sagen nichts|sagt nichts|steht nichts|enthalten nichts|findet sich nichts|lässt sich nichts|nichts zu finden|weiß nichts|die antwort fehlt|keine antwort|nicht hervor|nicht genannt|nicht erwähnt|reichen nicht|reicht nicht|weiß ich nicht|weiß es nicht|nicht genug|nicht genügend|keine information|keine informationen|nicht sagen|nicht bestimmen|nicht möglich|nicht feststellen|
non précisé|pas précisé|pas répondre|aucune réponse|pas de réponse|est inconnu|est inconnue|rien n'indique|rien ne permet|rien ne dit|rien ne précise|ne disent rien|ne dit rien|n'indiquent rien|n'indique rien|rien à ce sujet|la réponse manque|pas assez|ne dispose pas|ne permettent pas|ne permet pas|pas mentionné|pas indiqué|ne sais pas|impossible de|aucune information|pas d'information|pas d'informations|aucun passage|aucun des passages|est insuffisant|est insuffisante|sont insuffisants|sont insuffisantes|ne peux pas|
no especificado|no especificada|no dispongo|no puedo|es desconocido|se desconoce|no dicen nada|no dice nada|nada al respecto|falta la respuesta|sin respuesta|no hay información|no se menciona|no consta|no lo sé|no sé|no se indica|no se especifica|es insuficiente|son insuficientes|información insuficiente|no es posible|es imposible|imposible saber|imposible responder|imposible determinar|ningún pasaje|no tengo|no se puede|
non specificato|non specificata|non ho abbastanza|non posso|è sconosciuto|la risposta manca|non dicono nulla|non dicono niente|nessuna risposta|non è indicato|non è specificato|non è possibile|non lo so|non so|sono insufficienti|informazioni insufficienti|non è menzionato|non dispongo|nessun passaggio|nessuna informazione|non ci sono informazioni|è impossibile|impossibile rispondere|impossibile dire|impossibile determinare|non si può|non si sa
"""
# German nouns of these predicates, capitalised in any text.
REFUSING_NOUNS = set("angabe angaben antwort information informationen".split())
# Answers that refuse when they are all there is.
BARE_REFUSALS = set("unknown|none|n a|na|not applicable|nothing|no idea|unsure|undetermined|unanswerable|indeterminate|unbekannt|unbestimmt|inconnu|inconnue|indéterminé|desconocido|desconocida|sconosciuto|sconosciuta".split("|"))
# Phrases after which an answer follows in spite of a doubt.
HEDGES = """
yet the answer|but the answer|the answer should be|answer is likely|answer is probably|should be|points to|point to|give|gives|suggest|suggests|most likely|probably|presumably|my best guess|likely|
wohl|vermutlich|wahrscheinlich|deutet auf|sollte|dürfte|ergibt|ergeben|spricht für|trotzdem|
sans doute|probablement|devrait|donne|donnent|indique que c'est|semble être|la réponse serait|
probablemente|debería|dan como|apunta a|apuntan a|parece ser|la respuesta sería|indica que es|
probabilmente|dovrebbe|indicano che|sembra|la risposta sarebbe|danno come|punta a
"""
# Common function words by language.
WORDS = {
    "en": "the of and in to is was were are by for with on at from that this which who what when where how it its as an be been has have had first they their he she his her or not but year born led after both between than same known founded yes no came gave made won did does older earlier later one name named called about",
    "de": "der die das und in zu ist war waren von für mit auf an aus dass dieser diese dieses welche welcher welches wer was wann wo wie es im am ein eine einer einem einen den dem des als wurde wurden hat haben hatte nicht aber jahr geboren nach beide zwischen bei zum zur ja nein sich auch kam stammt gegründet heißt lautet älter früher sie er ihr sein",
    "fr": "le la les des du de et en à est était étaient par pour avec sur dans que qui cette ce quel quelle quels quelles quand où comment il elle un une au aux plus été a ont avait ne pas mais année né née après entre oui non son sa ses comme leur deux dont fut se même chanson fondé fondée",
    "es": "el la los las del de y en es era eran fue fueron por para con sobre que quien este esta cual cuál qué cuándo dónde cómo un una al más se lo su sus no sí pero año nació después entre como ha han había ambos dos desde también misma mismo canción fundado fundada persona ciudad",
    "it": "il lo la gli le del della dei delle di e in è era erano fu da per con su che chi questo questa quale quali quando dove come un una uno al alla nel nella più si suo sua non sì ma anno nato nata dopo tra fra ha hanno aveva entrambi due anche stesso stessa canzone fondato fondata sono dal dalla",
}
# Function words of further languages that none of the above has.
MORE_WORDS = {
    "nl": "het een van werd geboren naar niet zijn haar hij zij ze voor deze welke wie waar wanneer maar ook bij uit",
    "pt": "não uma foi em seu sua nasceu onde quando quem mas também são os dos das pelo pela você isso ela ele",
    "pl": "jest był była było się nie urodził urodziła oraz który która przez dla czy roku ale też jego jej został",
    "sv": "och är var född den det som inte hans hennes från till med ett på av år grundades",
    "da": "og af blev født ikke hendes fra til det på han hun var i byen",
    "cs": "byl byla bylo jest se narodil narodila který která není také jeho její podle roce ve",
    "fi": "on oli ja ei hän syntyi syntynyt joka vuonna myös kaupungissa",
    "ro": "este sunt și nu a fost născut născută în pe care cu din pentru această",
    "tr": "bir ve bu için doğdu olan değil ile da de yılında kim nerede",
    "hu": "és egy az nem volt született hogy is aki ami évben városban",
    "id": "yang dan di dari tidak adalah lahir pada untuk dengan oleh ini itu",
}
#: Scripts by ranges of code points; a script of its own is a vote against a question without it.
SCRIPTS = {"greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "thai": [(0xE00, 0xE7F)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)]}
#: Letters of a script without capitals that make a wording rather than a name.
UNCASED = 6
# Words that introduce an answer or a repeated question.
LEAD_INS = set("the question is was asks asked you ask your here answer to this that so well ok okay sure of course let me see think about regarding as for in reply response says reads again repeat repeated restated q a i we are want know would like frage antwort die der lautet auf question réponse la est à pregunta respuesta es domanda risposta è alla final my and it good great".split())

_PLAIN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PIECES = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")
MIN_RUN = 5
#: A copy covers this share of the question's letters and words, in runs of the suffix automaton.
COPY_QUESTION, COPY_WORDS, LONG_RUN = 0.75, 0.75, 0.8
# Words that ask.
ASKING = set("who whom whose what which when where how why wer wen wem was wann wo wie welche welcher welches welchem qui que quoi quel quelle quels quelles quand où comment combien lequel laquelle quién quiénes qué cuál cuáles cuándo dónde cómo cuántos cuántas chi che cosa quale quali quando dove come quanti quante".split())
ARTICLES = set("the das der die le la les el los las il lo i gli un une una uno ein eine a an".split())


def plain(text: str) -> str:
    return " ".join(_PLAIN.findall(text.replace("’", "'").lower()))


@lru_cache(1)
def _automata() -> tuple:
    import ahocorasick

    made = []
    for phrases in (REFUSALS, HEDGES):
        a = ahocorasick.Automaton()
        for p in filter(None, (x.strip() for x in phrases.replace("\n", "").split("|"))):
            a.add_word(f" {p} ", p)
        a.make_automaton()
        made.append(a)
    return tuple(made)


_SENTENCE = re.compile(r"[.!?:;\n(\"“]\s*$")


def _in_title(answer: str, words: list[re.Match], first: int, last: int) -> bool:
    """A longer word of the phrase is capitalised though neither its place nor the text asks for it."""
    for m in words[first : last + 1]:
        w = m.group()
        if len(w) > 3 and w[0].isupper() and w.lower() not in REFUSING_NOUNS and m.start() and not _SENTENCE.search(answer[max(0, m.start() - 4) : m.start()]):
            return True
    return False


def refuses(answer: str) -> bool:
    refusal, hedge = _automata()
    text = plain(answer)
    if text in BARE_REFUSALS:
        return True
    text = f" {text} "
    found = [(end, p) for end, p in refusal.iter(text)]
    if not found:
        return False
    answer = answer.replace("’", "'")
    words = list(_PLAIN.finditer(answer))
    if answer.upper() != answer:
        number = lambda end: text.count(" ", 0, end) - 1  # noqa: E731  (word before the blank at ``end``)
        found = [(end, p) for end, p in found if not _in_title(answer, words, number(end) - p.count(" "), number(end)) and not (p.endswith("known") and text.startswith("as ", end + 1))]
    if not found:
        return False
    start = min(end for end, _ in found)
    return not any(end > start and not text.endswith("give an answer ", 0, end + 11) for end, _ in hedge.iter(text))


class SuffixAutomaton:
    """Of one text; ``runs`` gives the longest match that ends at each position of another."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            cur = self._state({}, self.len[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    twin = self._state(dict(self.next[q]), self.len[p] + 1, self.end[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, nxt: dict[str, int], length: int, end: int) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.len.append(length)
        self.end.append(end)
        return len(self.len) - 1

    def runs(self, text: str) -> Iterator[tuple[int, int]]:
        """(length, end in the automaton's text) at each position of ``text``."""
        state = length = 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield length, self.end[state]


@lru_cache(4096)
def _of_question(text: str) -> SuffixAutomaton:
    return SuffixAutomaton(text)


def coverage(question: str, answer: str) -> tuple[float, float]:
    """Share of the question's letters in matched runs, and its longest run as a share."""
    in_q, longest = bytearray(len(question)), 0
    for length, end in _of_question(question).runs(answer):
        if length >= MIN_RUN:
            in_q[end - length + 1 : end + 1] = b"\1" * length
            longest = max(longest, length)
    return sum(in_q) / len(question), longest / len(question)


def _close(a: str, b: str) -> bool:
    """Equal but for a small slip: at most two letters inserted, lost or exchanged."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= (2 if min(len(a), len(b)) > 4 else 1)


def copies(question: str, answer: str) -> bool:
    """The answer says the question again and nothing else.

    All conditions must hold; those on words come first, as they are cheap, then the runs of the automaton.
    """
    q, a = plain(question), plain(answer)
    if not q or not a:
        return False
    q_words, a_words = q.split(), a.split()
    said = set(a_words)
    known = set(q_words) | LEAD_INS
    if any(not any(_close(w, x) for x in q_words) for w in said - known):
        return False
    missing = [w for w in q_words if w not in said and not any(_close(w, x) for x in a_words)]
    if len(missing) > (1 - COPY_WORDS) * len(q_words):
        return False
    of_question, longest = coverage(q, a)
    return of_question >= COPY_QUESTION and (longest >= LONG_RUN or not ASKING & set(missing))


_LANGUAGES: dict[str, list[str]] = {}
for _name, _text in WORDS.items():
    for _w in _text.split():
        _LANGUAGES.setdefault(_w, []).append(_name)
_OWN = set(_LANGUAGES)
for _name, _text in MORE_WORDS.items():
    for _w in set(_text.split()) - _OWN:
        _LANGUAGES.setdefault(_w, []).append(_name)
_BY_CODE = sorted((lo, hi, name) for name, parts in SCRIPTS.items() for lo, hi in parts)
_LOWS = [lo for lo, _, _ in _BY_CODE]


def scripts(text: str, names: bool = True) -> dict[str, int]:
    """Letters by script; without ``names`` those of lower-case words and of scripts without capitals."""
    out: dict[str, int] = {}
    if text.isascii():
        return {"latin": len(text)} if any(c.isalpha() if names else c.islower() for c in text) else {}
    for m in _PLAIN.finditer(text):
        w = m.group()
        if not names and w[0].isupper():
            continue
        for c in w:
            if c.isalpha():
                at = bisect.bisect_right(_LOWS, ord(c)) - 1
                name = _BY_CODE[at][2] if at >= 0 and ord(c) <= _BY_CODE[at][1] else "latin"
                out[name] = out.get(name, 0) + 1
    return out


def votes(text: str) -> dict[str, float]:
    """Votes of function words; a word of several languages splits its vote, a capitalised first word of several has half of one."""
    pieces = _PIECES.findall(text.replace("’", "'"))
    shout = text.upper() == text
    small = lambda i: 0 <= i < len(pieces) and (pieces[i][0].islower() or shout or i == 0)
    out: dict[str, float] = {}
    for i, w in enumerate(pieces):
        if not small(i):
            continue
        if not shout and w in ("of", "the", "and", "or") and i and not small(i - 1) and i + 1 < len(pieces) and pieces[i + 1][:1].isupper() and w == "of":
            continue  # inside a title
        if i == 0 and not shout and w[0].isupper() and w.lower() in ARTICLES:
            continue  # may begin a title
        for part in w.lower().split("'") if "'" in w else [w.lower()]:
            for name in _LANGUAGES.get(part, ()):
                out[name] = out.get(name, 0) + (0.5 if i == 0 and len(pieces) > 1 and not shout and w[0].isupper() else 1) / len(_LANGUAGES[part])
    return out


@lru_cache(4096)
def _asked(question: str) -> tuple[dict[str, float], frozenset[str]]:
    return votes(question), frozenset(scripts(question))


def foreign(question: str, answer: str) -> bool:
    """Worded in a script that the question doesn't use, or with the function words of another language."""
    q, used = _asked(question)
    said = scripts(answer, names=False)
    if said and used:
        name = max(said, key=said.get)
        cased = name in ("latin", "greek", "cyrillic")
        if name not in used and not (name in ("han", "kana") and used & {"han", "kana"}) and said[name] >= (2 if cased else UNCASED):
            if name != "latin" or len(votes(answer)) > 0:
                return True
    a = votes(answer)
    if not q or not a:
        return False
    own = max(q, key=q.get)
    best = max(a, key=a.get)
    return best != own and a[best] >= 1 and a[best] >= 1.6 * a.get(own, 0)


_DELIMITERS = re.compile(r'"(?:[^"\\]|\\.)*(?P<shut>"|\Z)|\\?\Z|```|[\[\]{}]', re.DOTALL)


def unfinished(response: str) -> bool:
    """Structure that a delimiter stack finds open at the end of a JSON or bracketed response."""
    text = response.strip()
    if not text or text[0] not in "[{`":
        return False
    stack: list[str] = []
    for m in _DELIMITERS.finditer(text):
        c = m.group()
        if not c:
            continue
        if c[0] == '"':
            if not m["shut"]:
                return True
        elif c == "```":
            if stack and stack[-1] == "`":
                stack.pop()
            else:
                stack.append("`")
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif stack and stack[-1] == c:
            stack.pop()
    return bool(stack) or (text.startswith("[SP:") and "[ANS:" not in text)


_STATED = re.compile(r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"|(?:^|\n)[^\n]{0,30}?answer(?: is)?\s*[:\-–]\s*([^\n]+)', re.IGNORECASE)


def stated(response: str) -> str | None:
    """The answer that a response states last."""
    found = _STATED.findall(response)
    return (found[-1][0] or found[-1][1]).strip() if found else None


def shortened(answer: str, response: str) -> bool:
    """The response states more than the answer: its stated answer goes on, or every mention is inside a word."""
    a, s = answer.strip(), stated(response)
    if a and s and s.startswith(a) and re.search(r"[^\W_]", s[len(a) :]) and a[-1] not in ".!?":
        return True
    if len(a) < 4 or not a[-1].isalnum():
        return False
    at, found = response.find(a), False
    while at >= 0:
        after, before = response[at + len(a) : at + len(a) + 1], response[at - 1 : at] if at else ""
        if not before.isalnum():
            if not after.isalnum():
                return False
            found = True
        at = response.find(a, at + 1)
    return found


def first_defect(question: str | None, answer: str | None) -> str | None:
    if answer is None or not re.search(r"[^\W_]", answer):
        return "empty"
    if refuses(answer):
        return "refusal"
    if question and question.strip():
        if copies(question, answer):
            return "copied_question"
        if foreign(question, answer):
            return "other_language"
    return None


# Words of assent and denial.
YES_NO = set("yes no ja nein oui non sí si no".split())


# Small words inside names.
JOINING = set("of the and de la le les du des del di da von der van und y e et in on at a".split())


def name_like(answer: str) -> bool:
    """A name or title: no word in lower case but those that join it, and none of these last."""
    words = _PLAIN.findall(answer)
    return bool(words) and not words[-1][0].islower() and all(not w[0].islower() or w in JOINING for w in words)


def whole(question: str | None, answer: str) -> bool:
    """The answer can't be cut: it is yes or no, or a name that the question has as it is."""
    a = plain(answer)
    return a in YES_NO or (len(a) > 1 and bool(question) and name_like(answer) and answer[-1:].isalnum() and f" {a} " in f" {plain(question)} ")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for q, a, r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            defect, open_ = first_defect(q, a), bool(r) and unfinished(r)
            # an end that more text goes on from
            more = bool(a and r) and not open_ and shortened(a, r)
            says = stated(r) if r and not open_ and r.lstrip()[:1] in ("[", "{", "`") else None
            out.append((defect, open_ or more, bool(a) and not more and whole(q, a), says.strip().lower() if says and name_like(says) else None))
        columns = list(zip(*out)) if out else [()] * 4
        types = [pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", "asked", "defect", "unfinished", "named", "says"])


STRUCTURED = r"^\s*[\[{`]"
#: Below this share of its occurrences at an end, a place is inside a sentence.  Answers share their contexts
#: with the middle of responses, so this is lower than for documents.
ENDS = 0.04
WITNESSES = 2


def inspect(df: DataFrame, id_col: str = "pred_id", question: str = "question", answer: str = "answer", response: str = "full_response") -> DataFrame:
    """(id, defect, ...): every pair with its defect, NULL for a sound one, and the evidence of its ends."""
    rows = df.select(F.col(id_col).alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(response).alias("r")).where(F.col("id").isNotNull())
    plain_of = lambda c: F.lower(F.trim(F.col(c)))
    quick = settle(rows.select("id", "q", "a", "r", F.xxhash64(plain_of("q")).alias("asked")).mapInArrow(_batches, "id bigint, asked bigint, defect string, unfinished boolean, named boolean, says string"), "pair-quick")
    # a response that closes with the answer ends as the answer does
    same = F.coalesce(F.endswith(F.rtrim("r"), F.rtrim("a")) & (F.trim("a") != ""), F.lit(False))
    prose = F.when(~F.col("r").rlike(STRUCTURED) & ~same, F.col("r"))
    single = F.coalesce(~F.trim("a").rlike(r"[\s\p{Punct}]"), F.lit(False))
    # answers get even ids, responses odd ones
    ends = rows.select(F.inline(F.array(F.struct((F.col("id") * 2).alias("id"), F.col("a").alias("text"), single.alias("single")), F.struct((F.col("id") * 2 + 1).alias("id"), prose.alias("text"), F.lit(False).alias("single"))))).where(F.col("text").isNotNull())
    corpus = rows.select(F.explode(F.array("q", "a", "r")).alias("text"))
    tail = settle(tails.tails(ends), "pair-tails")
    found = tails.judged(tail.drop("lines"), tails.counts(corpus, tail))
    bare = F.coalesce(F.col("suffix").rlike(r"^[\s,;:\-–—/&(\[{«“]*(\.\.\.|…)?$"), F.lit(False))
    # a name that finished responses to WITNESSES different questions state as their answer is whole
    stated_ = quick.where("says IS NOT NULL").groupBy(F.xxhash64("says").alias("t")).agg(F.count_distinct("asked").alias("k")).where(F.col("k") >= WITNESSES)
    asked = rows.select("id", F.xxhash64(plain_of("a")).alias("t")).join(stated_, "t", "left").select("id", F.col("k").isNotNull().alias("stated"))
    # one word alone says nothing about places, and one letter may be the answer
    cut = F.col("broken") | (bare & F.when(F.col("single"), cut_word() & (F.length("word") > 1)).otherwise(cut_word() | cut_place(ENDS)))
    sides = found.join(ends.select("id", "single"), "id").select(F.floor(F.col("id") / 2).alias("id"), F.pmod("id", F.lit(2)).alias("side"), F.coalesce(cut, F.lit(False)).alias("cut"), "word", "suffix", "seen", "longer", "p_end", "support")
    by = sides.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.struct("cut", "word", "suffix", "seen", "longer", "p_end", "support"))).alias("a_end"), F.max(F.when(F.col("side") == 1, F.struct("cut", "word", "suffix", "seen", "longer", "p_end", "support"))).alias("r_end"))
    cut_answer = F.coalesce(F.col("a_end.cut"), F.lit(False)) & ~F.col("named") & ~F.col("stated")
    cut_either = F.col("unfinished") | cut_answer | F.coalesce(F.col("r_end.cut"), F.lit(False))
    defect = F.coalesce("defect", F.when(cut_either, "truncated"))
    return quick.drop("asked").join(by, "id", "left").join(asked, "id").select("id", defect.alias("defect"), "unfinished", "a_end", "r_end")
