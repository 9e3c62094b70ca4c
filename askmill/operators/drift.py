"""Schemas that drift between files, by rescue-column ingestion.

``ingest`` reads raw JSON records under a target schema in one visit.  What the target columns hold exactly
goes into them; everything else goes to ``_rescued`` (a map field -> JSON): unknown fields, values of
another kind, explicit nulls, and of an object the inner keys that are unknown or don't fit (as an object
under the outer name).  Field names are map keys as they are, so a name with a dot is just a name.
Typed columns and ``_rescued`` rebuild the record (``rebuild``), before and after ``replay``.

``replay`` fills typed columns from rescued values: first of a column's own name, then of names approved for
it.  A value that the column holds exactly leaves ``_rescued`` and its old name goes to ``_replayed``; one that
had to be cast (an index in text, an object for a pair, a text in a list) fills the column and stays.
``promotions`` approves, by run, what the renames found there connect with a target column.

``changes`` compares each file with the one before it in its run.  Which fields a record has, and of which
kinds, is read off the ingested row: typed columns have the kinds of the target, the rest is the profile of
the rescue column, made in the same visit.

Defined cases: unreadable, empty or NULL payloads, payloads that are no JSON object and such with numbers that
aren't finite give a row with ``_readable`` false, whose payload is kept in ``_corrupt``; they take no part
in the report.  Numbers count by their value as doubles, a repeated key by its last value.  Rows delivered twice
count twice, which changes no set; a file with no readable record has no fields and is compared as such; extra
columns are kept, those named like a column made here with the prefix ``src_``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.plans.workspace import settle

#: Target table of predictions: column -> Spark type.
TARGET = {
    "question": "string",
    "gold_answer": "string",
    "answer": "string",
    "sp": "array<struct<title:string,sentence_index:int>>",
    "full_response": "string",
    "verification": "struct<support_score:double,is_supported:boolean,evidence_count:int>",
    "decision": "struct<confidence:double,verifier_supported:boolean>",
}
#: Inner columns of the target's objects.
INNER = {t: dict(x.split(":") for x in how[7:-1].split(",")) for t, how in TARGET.items() if how.startswith("struct<")}
#: A renamed field agrees with the old one on at least this share of the questions that have both.
RENAME_SHARE = 0.5

PROMOTED = "array<struct<name:string,column:string>>"
_RESCUE = "_rescued map<string,string>"
_PROFILE = "_profile array<struct<at:string,field:string,kinds:array<string>,value:string>>"
_NOTHING = object()

_SCALAR = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
_MAP = pa.map_(pa.string(), pa.string())
_ENTRY = pa.list_(pa.struct([("at", pa.string()), ("field", pa.string()), ("kinds", pa.list_(pa.string())), ("value", pa.string())]))


def _arrow(t: str) -> pa.DataType:
    if t in INNER:
        return pa.struct([(k, _SCALAR[x]) for k, x in INNER[t].items()])
    return pa.list_(pa.struct([("title", pa.string()), ("sentence_index", pa.int32())])) if t == "sp" else pa.string()


def kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def kinds(v: object, at: str = "") -> set[str]:
    """JSON kinds of a value; those found inside arrays carry their depth as leading '['. Empty values have none."""
    if v is None or v in ("", [], {}):
        return set()
    found = {at + kind(v)}
    if isinstance(v, list):
        for x in v:
            found |= kinds(x, at + "[")
    return found


def _sound(s: str) -> bool:
    """A text that UTF-8 can hold (JSON can escape half a surrogate pair)."""
    try:
        s.encode()
    except UnicodeEncodeError:
        return False
    return True


def dump(v: object) -> str:
    """JSON text of a value; raises ValueError for numbers that aren't finite."""
    s = json.dumps(v, ensure_ascii=False, sort_keys=True, allow_nan=False)
    return s if _sound(s) else json.dumps(v, sort_keys=True)


def _plain(s: str) -> str:
    return s if _sound(s) else s.encode("utf-8", "backslashreplace").decode()


def content(v: object) -> str:
    """What a renamed field must keep: an object its keys, a list its leaves, anything else its value."""
    if isinstance(v, dict):
        return _plain(",".join(sorted(v)))
    if isinstance(v, list):
        return "".join(content(list(x.values()) if isinstance(x, dict) else x) for x in v)
    return _plain(v) if isinstance(v, str) else dump(v)


def _exact(v: object, how: str | None) -> bool:
    """The Spark type holds the value as it is."""
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if how == "string":
        return isinstance(v, str) and _sound(v)
    if how == "boolean":
        return isinstance(v, bool)
    if how == "int":
        return number and -(2**31) <= v < 2**31 and v == int(v)
    if how == "double":
        return number and abs(v) < 2**1023 and math.isfinite(v) and float(v) == v
    return False


def fit(t: str, v: object) -> tuple[object, object]:
    """(what the column ``t`` holds exactly, what is left); either may be nothing."""
    if t in INNER:
        if not isinstance(v, dict):
            return _NOTHING, v
        known = {k: int(x) if INNER[t][k] == "int" else x for k, x in v.items() if _exact(x, INNER[t].get(k))}
        rest = {k: x for k, x in v.items() if k not in known}
        return known, rest or _NOTHING
    if t == "sp":
        pairs = isinstance(v, list) and all(isinstance(p, list) and len(p) == 2 and _exact(p[0], "string") and _exact(p[1], "int") for p in v)
        return ([{"title": a, "sentence_index": int(b)} for a, b in v], _NOTHING) if pairs else (_NOTHING, v)
    return (v, _NOTHING) if t in TARGET and _exact(v, "string") else (_NOTHING, v)


def _cast_scalar(v: object, how: str) -> object:
    if _exact(v, how):
        return int(v) if how == "int" else v
    if isinstance(v, str) and how == "boolean":
        return {"true": True, "false": False}.get(v.strip().lower())
    if isinstance(v, str) and how in ("int", "double"):
        try:
            x = float(v)
        except ValueError:
            return None
        return (int(x) if how == "int" else x) if _exact(x, how) else None
    return None


def cast(t: str, v: object) -> object:
    """The value of another form as the column ``t`` would hold it; None if there is none.

    Texts: the one text of a list or of an object, a number or boolean as JSON.  Facts: pairs or objects, an
    index may be text.  Inner columns: numbers and booleans in text.
    """
    if t in INNER:
        got = {k: x for k, how in INNER[t].items() if isinstance(v, dict) and (x := _cast_scalar(v.get(k), how)) is not None}
        return got or None
    if t == "sp":
        if not isinstance(v, list):
            return None
        out = []
        for p in v:
            title, index = (p["title"], p["sentence_index"]) if isinstance(p, dict) and {"title", "sentence_index"} <= set(p) else p if isinstance(p, list) and len(p) == 2 else (None, None)
            index = _cast_scalar(index, "int")
            if not _exact(title, "string") or index is None:
                return None
            out.append({"title": title, "sentence_index": int(index)})
        return out
    if isinstance(v, (list, dict)):
        inside = list(v.values()) if isinstance(v, dict) else v
        return inside[0] if len(inside) == 1 and _exact(inside[0], "string") else None
    return None if v is None else dump(v) if not isinstance(v, str) else v if _sound(v) else None


def visit(text: str | None) -> tuple[dict, list, list] | None:
    """(typed, rescued, profile of the rescued) of one record; None if it isn't readable.

    In the profile ``at`` is '' for a field of the record, '=outer' for an inner key.
    """
    try:
        record = json.loads(text) if text else None
        if not isinstance(record, dict):
            return None
        typed, rescued, profile = {}, [], []
        for name, v in record.items():
            known, rest = fit(name, v)
            if known is not _NOTHING:
                typed[name] = known
            if rest is _NOTHING:
                continue
            rescued.append((_plain(name), dump(rest)))
            if known is _NOTHING:
                profile.append({"at": "", "field": _plain(name), "kinds": sorted(kinds(v)), "value": content(v)})
            if isinstance(rest, dict):
                profile += [{"at": "=" + _plain(name), "field": _plain(k), "kinds": sorted(kinds(x)), "value": content(x)} for k, x in rest.items()]
    except (ValueError, RecursionError):
        return None
    return typed, rescued, profile


def rebuild(row: dict) -> dict:
    """The record of an ingested or replayed row: typed values under their own or old name, then the rescued ones.

    A rescued value stands before a typed one of its name; objects merge key by key.
    """
    old = dict(row.get("_replayed") or ())
    out: dict = {}
    for t in TARGET:
        v = row[t]
        if v is None:
            continue
        if t in INNER:
            v = {k: x for k, x in (v.asDict() if hasattr(v, "asDict") else v).items() if x is not None}
        elif t == "sp":
            v = [[f["title"], f["sentence_index"]] for f in v]
        out[old.get(t, t)] = v
    for name, text in dict(row["_rescued"] or ()).items():
        v = json.loads(text)
        out[name] = out[name] | v if isinstance(v, dict) and isinstance(out.get(name), dict) else v
    return out


def ingest(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One uniform table: the target columns, ``_rescued``, ``_readable``, ``_corrupt`` and ``_profile``."""
    made = {*TARGET, "_readable", "_corrupt", "_rescued", "_profile", "_replayed"}
    df = df.withColumnsRenamed({c: f"src_{c}" for c in df.columns if c in made and c != payload})
    keep, types = [c for c in df.columns if c != payload], dict(df.dtypes)
    names = [*keep, "_readable", "_corrupt", *TARGET, "_rescued", "_profile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [visit(x) for x in texts]
            typed = [f[0] if f else {} for f in found]
            columns = [pa.array([f is not None for f in found], pa.bool_()), pa.array([None if f else x for f, x in zip(found, texts)], pa.string())]
            columns += [pa.array([r.get(t) for r in typed], _arrow(t)) for t in TARGET]
            columns += [pa.array([f[1] if f else [] for f in found], _MAP), pa.array([f[2] if f else [] for f in found], _ENTRY)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "_readable boolean, _corrupt string", *(f"{t} {how}" for t, how in TARGET.items()), _RESCUE, _PROFILE])
    return df.select(*(F.col(f"`{c}`") for c in keep), payload).mapInArrow(run, schema)


def _fill(typed: dict, rescued: dict[str, str], names: dict[str, list[str]]) -> dict[str, str]:
    """Fills ``typed`` from ``rescued`` in place; gives column -> old name."""
    moved = {}
    for t, approved in names.items():
        for name in (t, *approved):
            if name not in rescued:
                continue
            v = json.loads(rescued[name])
            if typed[t] is None:
                known, rest = fit(t, v)
                if known is _NOTHING or (t in INNER and not known):
                    known = cast(t, v)
                    if known is None:
                        continue
                elif rest is _NOTHING:
                    del rescued[name]
                else:
                    rescued[name] = dump(rest)
                    known = (cast(t, rest) or {}) | known
                typed[t] = known
                if name != t:
                    moved[t] = name
                break
            if name == t and t in INNER and isinstance(v, dict):
                typed[t] = typed[t] | {k: x for k, x in (cast(t, v) or {}).items() if typed[t].get(k) is None}
            break
    return moved


def replay(ingested: DataFrame, aliases: dict[str, str], promoted: DataFrame | None = None, run: str = "run_name") -> DataFrame:
    """Fill typed columns from rescued values of their own name and of approved ones (``aliases``: field -> column).

    ``promoted`` (see ``promotions``) approves more fields by run; they go before ``aliases``.  ``_replayed`` maps
    a column to the name its value came under.
    """
    types, keep = dict(ingested.dtypes), ingested.columns
    rows = ingested.withColumn("_promoted", F.lit(None).cast(PROMOTED))
    if promoted is not None:
        p = promoted.select(F.col(run).alias("_run"), F.col("promoted").alias("_promoted"))
        rows = ingested.join(p, F.col(run).eqNullSafe(F.col("_run")), "left").drop("_run")

    def of(own: list[dict] | None) -> dict[str, list[str]]:
        first = {x["name"]: x["column"] for x in own or ()}
        both = first | {a: t for a, t in aliases.items() if a not in first}
        return {t: [a for a, c in both.items() if c == t] for t in TARGET}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [keep.index(t) for t in TARGET]
        where, known = keep.index("_rescued"), {}
        for b in batches:
            typed = [dict(zip(TARGET, r)) for r in zip(*(b.column(i).to_pylist() for i in at))]
            rescued = [dict(r or ()) for r in b.column(where).to_pylist()]
            moved = []
            for values, rest, own in zip(typed, rescued, b.column(len(keep)).to_pylist()):
                key = repr(own)
                if key not in known:
                    known[key] = of(own)
                moved.append(list(_fill(values, rest, known[key]).items()) if rest else [])
            columns = list(b.columns[: len(keep)])
            for t, i in zip(TARGET, at):
                columns[i] = pa.array([r[t] for r in typed], _arrow(t))
            columns[where] = pa.array([list(r.items()) for r in rescued], _MAP)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(moved, _MAP)], [*keep, "_replayed"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "_replayed map<string,string>"])
    return rows.select(*(F.col(f"`{c}`") for c in keep), "_promoted").mapInArrow(work, schema)


def promoted_names(renames: list[tuple[str, str]]) -> dict[str, str]:
    """field -> target column, for the names that chains of renames (old, new) lead to from a target column or to one.

    The nearest target counts, the earlier rename on ties; a target's own name is never promoted.
    """
    found: dict[str, str] = {}
    last = {t: t for t in TARGET}
    while last:
        step: dict[str, str] = {}
        for old, new in renames:
            for a, b in ((old, new), (new, old)):
                if a in last and b not in TARGET and b not in found:
                    step.setdefault(b, last[a])
        found |= step
        last = step
    return found


def promotions(ingested: DataFrame, run: str = "run_name", number: str = "file_no", file: str = "file_name", question: str = "question_id") -> DataFrame:
    """(run, promoted): the fields of each run that its detected renames connect with a target column."""
    renamed = compared(ingested, run, number, file, question).where((F.col("change") == "renamed") & (F.col("at") == ""))

    def names(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["number", "field"])
        found = promoted_names(list(zip(g["field"], g["new_field"])))
        return pd.DataFrame({"run": [g["run"].iloc[0]], "promoted": [[{"name": k, "column": t} for k, t in found.items()]]})

    one = renamed.select(F.col(run).alias("run"), F.col(number).alias("number"), "field", "new_field")
    return one.groupBy("run").applyInPandas(names, f"run {dict(ingested.dtypes)[run]}, promoted {PROMOTED}").withColumnRenamed("run", run)


def observed() -> Column:
    """All fields of an ingested row (at, field, kinds, value): what the typed columns hold, and the profile of the rest."""
    none, text = F.array().cast("array<string>"), lambda *xs: F.array(*map(F.lit, xs))
    entry = lambda there, at, field, ks, value: F.when(there, F.struct(F.lit(at).alias("at"), F.lit(field).alias("field"), ks.alias("kinds"), value.cast("string").alias("value")))
    simple = {"string": "string", "boolean": "boolean", "int": "number", "double": "number"}

    def scalar(c: Column, how: str, at: str, field: str) -> Column:
        return entry(c.isNotNull(), at, field, F.when(c == "", none).otherwise(text("string")) if how == "string" else text(simple[how]), c)

    out = []
    for t, how in TARGET.items():
        c = F.col(t)
        if t in INNER:
            left = F.coalesce(F.json_object_keys(F.element_at("_rescued", F.lit(t))), none)
            keys = F.array_union(F.filter(F.array(*(F.when(c[k].isNotNull(), k) for k in INNER[t])), lambda k: k.isNotNull()), left)
            out.append(entry(c.isNotNull(), "", t, F.when(F.size(keys) > 0, text("object")).otherwise(none), F.array_join(F.array_sort(keys), ",")))
            out += [scalar(c[k], x, f"={t}", k) for k, x in INNER[t].items()]
        elif t == "sp":
            titled = F.exists(c, lambda f: f["title"] != "")
            ks = F.when(F.size(c) == 0, none).otherwise(F.concat(text("array", "[array", "[[number"), F.when(titled, text("[[string")).otherwise(none)))
            out.append(entry(c.isNotNull(), "", t, ks, F.array_join(F.transform(c, lambda f: F.concat(f["title"], f["sentence_index"].cast("string"))), "")))
        else:
            out.append(scalar(c, how, "", t))
    return F.concat(F.filter(F.array(*out), lambda x: x.isNotNull()), F.col("_profile"))


def _alike(a: Column, b: Column) -> Column:
    """Equal, the same but for case, white space, quotes and brackets, or equal as numbers."""
    plain = lambda c: F.lower(F.regexp_replace(c, r'[\s"\[\]{}.,\\]+', ""))
    return (a == b) | (plain(a) == plain(b)) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))


def changes(ingested: DataFrame, run: str = "run_name", number: str = "file_no", file: str = "file_name", question: str = "question_id") -> DataFrame:
    """(file_name, change, field, new_field): each file against the file of its run numbered one less."""
    named = lambda c: F.when(F.col("at") == "", F.col(c)).otherwise(F.concat(F.substring("at", 2, 1 << 30), F.lit("."), F.col(c)))
    new = F.when(F.col("change") == "renamed", named("new_field")).otherwise("")
    return compared(ingested, run, number, file, question).select(F.col(file).alias("file_name"), "change", named("field").alias("field"), new.alias("new_field"))


def compared(ingested: DataFrame, run: str, number: str, file: str, question: str) -> DataFrame:
    """(run, number, file, change, at, field, new_field): the changes; ``at`` is '' or '=outer' for an inner key.

    Fields are pre-aggregated per file before anything else, so the report handles a few rows per
    file.  Only fields that went or came are compared by question, and only between two neighbours.
    """
    keys = [run, number]
    parts = ingested.select(*keys, file, question, F.explode_outer(F.when(F.col("_readable"), observed())).alias("f")).select(*keys, file, question, "f.*")
    parts = settle(parts, "drift")  # one visit; a record without fields keeps its file
    files = settle(parts.groupBy(*keys).agg(F.min(file).alias(file)), "drift-files")
    one = parts.where(F.col("field").isNotNull()).drop(file)
    name = ["at", "field"]
    per = one.groupBy(*keys, *name).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("k"))
    per = settle(per, "drift-fields")  # a few rows per file, read by every branch below
    old = per.select(run, (F.col(number) + 1).alias(number), *name, F.col("k").alias("old_k"))
    pairs = files.select(*keys).join(files.select(run, (F.col(number) + 1).alias(number)), keys)
    both = old.join(per.withColumnRenamed("k", "new_k"), [*keys, *name], "full").join(pairs, keys, "left_semi")
    # an inner key counts only where its field is an object under one name in both files
    is_object = lambda k: F.coalesce(F.array_contains(k, "object"), F.lit(False))
    shared = both.where((F.col("at") == "") & is_object("old_k") & is_object("new_k")).select(*keys, F.concat(F.lit("="), "field").alias("at"))
    inner = both.where(F.col("at") != "").join(shared, [*keys, "at"], "left_semi").select(both.columns)
    seen = settle(both.where(F.col("at") == "").unionByName(inner), "drift-seen")
    retyped = seen.where((F.size("old_k") > 0) & (F.size("new_k") > 0) & (F.col("old_k") != F.col("new_k"))).select(*keys, F.lit("type_changed").alias("change"), *name, F.lit("").alias("new_field"))
    gone = seen.where(F.col("new_k").isNull()).select(*keys, "at", F.col("field").alias("gone"), F.col("old_k"))
    come = seen.where(F.col("old_k").isNull()).select(*keys, "at", F.col("field").alias("come"), F.col("new_k"))
    maybe = gone.join(come, [*keys, "at"]).where(F.arrays_overlap("old_k", "new_k")).select(*keys, "at", "gone", "come")
    maybe = settle(maybe, "drift-maybe")  # pairs of field names, a few per file
    asked = maybe.select(run, (F.col(number) - 1).alias(number), "at", F.col("gone").alias("field")).unionByName(maybe.select(*keys, "at", F.col("come").alias("field"))).distinct()
    values = one.where(F.size("kinds") > 0).join(asked, [*keys, *name], "left_semi").groupBy(*keys, question, *name).agg(F.max("value").alias("v"))
    before = values.select(run, (F.col(number) + 1).alias(number), question, "at", F.col("field").alias("gone"), F.col("v").alias("old_v"))
    met = maybe.join(before, [*keys, "at", "gone"]).join(values.select(*keys, question, "at", F.col("field").alias("come"), F.col("v").alias("new_v")), [*keys, question, "at", "come"])
    score = met.groupBy(*keys, "at", "gone", "come").agg(F.avg(_alike(F.col("old_v"), F.col("new_v")).cast("double")).alias("share")).where(F.col("share") >= RENAME_SHARE)
    # each name takes part in one renaming: the best for both sides, ties by name
    best = score.groupBy(*keys, "at", "gone").agg(F.min_by("come", F.struct(-F.col("share"), F.col("come"))).alias("come"), F.max("share").alias("share"))
    renamed = best.groupBy(*keys, "at", "come").agg(F.min_by("gone", F.struct(-F.col("share"), F.col("gone"))).alias("gone")).select(*keys, "at", "gone", "come")
    renamed = settle(renamed, "drift-renamed")
    went = gone.join(renamed, [*keys, "at", "gone"], "left_anti").select(*keys, F.lit("removed").alias("change"), "at", F.col("gone").alias("field"), F.lit("").alias("new_field"))
    came = come.join(renamed, [*keys, "at", "come"], "left_anti").select(*keys, F.lit("added").alias("change"), "at", F.col("come").alias("field"), F.lit("").alias("new_field"))
    moved = renamed.select(*keys, F.lit("renamed").alias("change"), "at", F.col("gone").alias("field"), F.col("come").alias("new_field"))
    found = retyped.unionByName(went).unionByName(came).unionByName(moved)
    return found.join(files, keys)
