"""Deeply nested records as related flat tables, by single-pass tagged emission.

One depth-first visit of each record emits one row per node:

    (tag, record, pk, parent_pk, pos, kind, label, payload)

``tag`` names the target table, ``pk`` is the path of the node below the record
(``17/context/3/sentence/0``), ``parent_pk`` the path of its parent, ``pos`` the position in the stored
array, ``kind`` the JSON kind of the node, ``label`` a short text needed to link rows, ``payload`` the
fields of the tag's schema as JSON, with ``rest``: the JSON of all that no other column holds (unknown keys, odd
entries, values of another kind).  Facts point into the contexts of their own record, so the visit resolves
them on the spot: each sentence a fact points to is a row of tag ``link`` below the fact, labelled with the
sentence's key, and no join is needed.  The tagged rows are written once, partitioned by tag, and each flat
table is that partition with its schema applied; so a query reads only the tables and columns it needs.

Two visitors give the same rows: ``visit_typed`` walks a typed column with Catalyst expressions (one
generated array, one ``inline``), ``visit_json`` walks raw JSON text of mixed shapes with a Python
visitor over Arrow batches.

Defined cases: a NULL or unreadable payload gives no row at all; NULL or empty arrays give no child
rows but keep their positions; an entry of no known shape gives a row of kind ``odd`` and no children; a key with
a null counts as missing; a text that UTF-8 can't hold is kept with escapes; titles compare without outer white
space and a blank title matches nothing; repeated records are told apart by ``record``, which must be unique;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions.text import let, strip
from askmill.plans.workspace import settle

TAGGED = "tag string, record bigint, pk string, parent_pk string, pos bigint, kind string, label string, payload string"

#: Schemas applied to the payload of each tag.
SCHEMAS = {
    "record": "id string, question string, answer string, type string, level string, rest string",
    "context": "passage_id string, rest string",
    "sentence": "text string",
    "fact": "sentence_index string, index_kind string, rest string",
    "link": "fact_pos bigint, sentence_pos bigint",
}


def _node(tag: str, record: Column, pk: Column, parent: Column, pos: Column, kind: Column, label: Column, payload: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.struct(F.lit(tag).alias("tag"), record.cast("bigint").alias("record"), text(pk).alias("pk"), text(parent).alias("parent_pk"), pos.cast("bigint").alias("pos"), text(kind).alias("kind"), text(label).alias("label"), text(payload).alias("payload"))


def visit_typed(df: DataFrame, record: str = "row_id") -> DataFrame:
    """Tagged rows of parsed records (columns of the ``examples`` table), JVM-side."""
    r, none = F.col(record), F.lit(None)
    path = lambda *parts: F.concat_ws("/", *parts)
    payload = F.to_json(F.struct("id", "question", "answer", F.col("question_type").alias("type"), F.col("question_level").alias("level")))
    root = _node("record", r, path(r.cast("string")), none, F.lit(0), F.lit("object"), none, payload)

    def context(c: Column, i: Column) -> Column:
        pk = path(r.cast("string"), F.lit("context"), i.cast("string"))

        def sentence(s: Column, j: Column) -> Column:
            return _node("sentence", r, path(pk, F.lit("sentence"), j.cast("string")), pk, j, F.when(s.isNull(), "null").otherwise("string"), none, F.to_json(F.struct(s.alias("text"))))

        own = _node("context", r, pk, path(r.cast("string")), i, F.when(c.isNull(), "odd").otherwise("object"), c["title"], F.to_json(F.struct(c["passage_id"].alias("passage_id"))))
        return F.concat(F.array(own), F.coalesce(F.transform(c["sentences"], sentence), F.array().cast(f"array<struct<{TAGGED_STRUCT}>>")))

    def fact(f: Column, i: Column) -> Column:
        index = f["sentence_index"]
        body = F.to_json(F.struct(index.cast("string").alias("sentence_index"), F.when(index.isNull(), "null").otherwise("number").alias("index_kind")))
        return _node("fact", r, path(r.cast("string"), F.lit("fact"), i.cast("string")), path(r.cast("string")), i, F.when(f.isNull(), "odd").otherwise("object"), f["title"], body)

    def links(named: Column) -> Column:
        """Link rows of all facts; ``named``: the stripped titles of the contexts, computed once per record."""

        def of(f: Column, i: Column) -> Column:
            pk, index = path(r.cast("string"), F.lit("fact"), i.cast("string")), f["sentence_index"]

            def at(title: Column) -> Column:
                def link(t: Column, j: Column) -> Column:
                    there = (t == title) & (title != "") & (index >= 0) & F.get(F.get("contexts", j)["sentences"], index).isNotNull()
                    body = F.to_json(F.struct(i.cast("bigint").alias("fact_pos"), index.cast("bigint").alias("sentence_pos")))
                    target = path(r.cast("string"), F.lit("context"), j.cast("string"), F.lit("sentence"), index.cast("string"))
                    return F.when(there, _node("link", r, path(pk, F.lit("link"), j.cast("string")), pk, j, F.lit("pointer"), target, body))

                return F.filter(F.transform(named, link), lambda x: x.isNotNull())

            return let(strip(f["title"]), at)

        return F.flatten(F.transform("supporting_facts", of))

    empty = F.array().cast(f"array<struct<{TAGGED_STRUCT}>>")
    found = let(F.transform("contexts", lambda c: strip(c["title"])), links)
    nodes = F.concat(F.array(root), F.coalesce(F.flatten(F.transform("contexts", context)), empty), F.coalesce(F.transform("supporting_facts", fact), empty), F.coalesce(found, empty))
    return df.where(r.isNotNull()).select(F.inline(nodes))


TAGGED_STRUCT = TAGGED.replace(" ", ":").replace(",:", ",")


def _kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def _dump(v: object) -> str:
    s = json.dumps(v, ensure_ascii=False)
    return s if _sound(s) else json.dumps(v)


def _sound(s: str) -> bool:
    try:
        s.encode()
    except UnicodeEncodeError:
        return False
    return True


def _as_text(v: object) -> str | None:
    if isinstance(v, str):
        return v if _sound(v) else v.encode("utf-8", "backslashreplace").decode()
    return v if v is None else _dump(v)


def _rest(values: object) -> str | None:
    return _dump(values) if values not in (None, {}) else None


_INTEGER = re.compile(r"[+-]?[0-9]{1,18}", re.ASCII)


def _position(index: object) -> int | None:
    """An index given as an integer or as a text that holds just one."""
    if isinstance(index, str):
        return int(index) if _INTEGER.fullmatch(index := index.strip()) else None
    return index if isinstance(index, int) and not isinstance(index, bool) else None


#: Columns of a record with the keys that may hold them, first ones first.
KEYS = {"id": ("_id", "id"), "question": ("question",), "answer": ("answer",), "type": ("type", "question_type"), "level": ("level", "question_level")}


def visit_record(record: int, text: str | None) -> Iterator[tuple]:
    """Depth-first visit of one raw record; yields rows in the order of TAGGED."""
    try:
        top = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return
    if not isinstance(top, dict):
        return
    root = str(record)
    held = {column: next((k for k in keys if top.get(k) is not None), None) for column, keys in KEYS.items()}
    body = {column: _as_text(top.get(k)) for column, k in held.items()}
    seen = {k for k in held.values() if isinstance(top.get(k), str)}
    contexts_at = next((k for k in ("context", "contexts") if top.get(k) is not None), None)
    contexts, facts = top.get(contexts_at), top.get("supporting_facts")
    seen |= {k for k, v in ((contexts_at, contexts), ("supporting_facts", facts)) if isinstance(v, list)}
    body["rest"] = _rest({k: v for k, v in top.items() if k not in seen and v is not None})
    yield "record", record, root, None, 0, "object", None, _dump(body)
    texts: dict[str, list[tuple[int, list]]] = {}
    for i, c in enumerate(contexts if isinstance(contexts, list) else []):
        pk, title, sentences, passage_id, rest = f"{root}/context/{i}", None, None, None, c
        kind = _kind(c)
        if isinstance(c, list) and len(c) == 2:
            title, sentences = c
            rest = {k: v for k, v, whole in (("title", title, isinstance(title, str)), ("sentences", sentences, isinstance(sentences, list))) if v is not None and not whole}
        elif isinstance(c, dict) and "title" in c:
            title, sentences, passage_id = c["title"], c.get("sentences"), c.get("passage_id")
            whole = {"title": isinstance(title, str), "sentences": isinstance(sentences, list), "passage_id": isinstance(passage_id, str)}
            rest = {k: v for k, v in c.items() if v is not None and not whole.get(k)}
        else:
            kind = "odd"
        label = _as_text(title) if isinstance(title, str) else None
        yield "context", record, pk, root, i, kind, label, _dump({"passage_id": _as_text(passage_id), "rest": _rest(rest)})
        sentences = sentences if isinstance(sentences, list) else []
        for j, s in enumerate(sentences):
            yield "sentence", record, f"{pk}/sentence/{j}", pk, j, _kind(s), None, _dump({"text": _as_text(s)})
        if isinstance(title, str) and title.strip():
            texts.setdefault(title.strip(), []).append((i, sentences))
    for i, f in enumerate(facts if isinstance(facts, list) else []):
        pk, title, index, rest = f"{root}/fact/{i}", None, None, f
        kind = _kind(f)
        if isinstance(f, list) and len(f) == 2:
            title, index = f
            rest = {"title": title} if title is not None and not isinstance(title, str) else None
        elif isinstance(f, dict) and "title" in f:
            title, index = f["title"], f.get("sentence_index")
            rest = {k: v for k, v in f.items() if v is not None and k != "sentence_index" and not (k == "title" and isinstance(v, str))}
        else:
            kind = "odd"
        body = {"sentence_index": _as_text(index), "index_kind": "real" if isinstance(index, float) else _kind(index), "rest": _rest(rest)}
        yield "fact", record, pk, root, i, kind, _as_text(title) if isinstance(title, str) else None, _dump(body)
        at = _position(index)
        for j, sentences in texts.get(title.strip(), ()) if isinstance(title, str) and at is not None else ():
            if 0 <= at < len(sentences) and isinstance(sentences[at], str):
                yield "link", record, f"{pk}/link/{j}", pk, j, "pointer", f"{root}/context/{j}/sentence/{at}", _dump({"fact_pos": i, "sentence_pos": at})


def _visit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TAGGED.split(", ")]
    types = [pa.int64() if x.endswith("bigint") else pa.string() for x in TAGGED.split(", ")]
    for b in batches:
        rows = [row for record, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for row in visit_record(record, text)]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def visit_json(df: DataFrame, record: str = "row_id", payload: str = "payload") -> DataFrame:
    """Tagged rows of raw JSON records of mixed shapes."""
    return df.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint"), payload).mapInArrow(_visit_batches, TAGGED)


def write_tagged(tagged: DataFrame, name: str = "tagged") -> DataFrame:
    """Write tagged rows partitioned by tag; the result prunes to the tags a reader filters on."""
    return settle(tagged, name, partition_by=["tag"])


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table: keys, position and the payload under the schema of its tag."""
    rows = tagged.where(F.col("tag") == tag)
    return rows.select("record", "pk", "parent_pk", "pos", "kind", F.col("label").alias("title"), F.from_json("payload", SCHEMAS[tag]).alias("_p")).select("record", "pk", "parent_pk", "pos", "kind", "title", "_p.*")


def resolve_facts(tagged: DataFrame) -> DataFrame:
    """(record, fact_pos, context_pos, sentence_pos) of facts that point to an existing text: the link rows."""
    return flat_table(tagged, "link").select("record", "fact_pos", F.col("pos").alias("context_pos"), "sentence_pos")
