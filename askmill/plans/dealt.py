"""Queries of the general data-processing problems (nested records, drifting schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators import drift, nested


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tagged_records(spark: SparkSession, sf: str) -> DataFrame:
    typed = nested.visit_typed(_table(spark, sf, "examples"))
    return typed.unionByName(nested.visit_json(_table(spark, sf, "raw_examples")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    tagged = nested.write_tagged(tagged_records(spark, sf), "p1")
    return nested.resolve_facts(tagged).withColumnRenamed("record", "row_id")


def _p1_flat(tag: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = nested.flat_table(nested.write_tagged(tagged_records(spark, sf), "p1"), tag)
        # what has no column of its own stays as JSON; the query says where there is some
        return rows.withColumn("has_rest", F.col("rest").isNotNull()).drop("rest") if "rest" in rows.columns else rows

    return query


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(drift.ingest(_table(spark, sf, "raw_predictions")))


#: Names seen in prediction files that are approved in every run; renames found in a run approve others there.
NAMES = {
    "question": ["query", "question_text", "q"],
    "gold_answer": ["gold", "goldAnswer", "expected_answer", "reference"],
    "answer": ["pred_text", "final_answer", "prediction"],
    "sp": ["cited", "evidence", "supporting_facts"],
    "full_response": ["response_text", "raw_response", "fullResponse", "completion"],
    "verification": ["verifier", "verificationResult"],
}
ALIASES = {name: column for column, names in NAMES.items() for name in names}


def uniform(spark: SparkSession, sf: str) -> DataFrame:
    """All records in one table; approved fields are replayed from the rescue column."""
    rows = drift.ingest(_table(spark, sf, "raw_predictions"))
    return drift.replay(rows, ALIASES, drift.promotions(rows)).drop("_profile")


def p2_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """The uniform table as plain columns, with the names of what stays rescued."""
    t = uniform(spark, sf)
    facts = F.array_join(F.transform("sp", lambda f: F.concat(f["title"], F.lit("::"), f["sentence_index"].cast("string"))), "|")
    texts = [c for c, how in drift.TARGET.items() if how == "string"]
    inner = [f"{t}.{k}" for t, ks in drift.INNER.items() for k in ks]
    return t.select("row_id", "run_name", "file_no", "question_id", "_readable", *texts, facts.alias("sp"), *inner, F.array_join(F.array_sort(F.map_keys("_rescued")), ",").alias("rescued"))


QUERIES = {"p2_found": p2_found, "p2_uniform": p2_uniform, "p1_found": p1_found} | {f"p1_{tag}s": _p1_flat(tag) for tag in nested.SCHEMAS}
_S = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_TEXT = lambda j: f"CASE WHEN json_type({j}) = 'VARCHAR' THEN json_extract_string({j}, '$') END"
_ENTRY = lambda e, key: f"CASE WHEN json_type({e}) = 'ARRAY' AND json_array_length({e}) = 2 THEN json_extract({e}, '$[{'0' if key == 'title' else '1'}]') WHEN json_type({e}) = 'OBJECT' THEN json_extract({e}, '$.{key}') END"
_P1 = f"""WITH r AS (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END j FROM raw_examples),
rc AS (SELECT row_id, unnest(json_extract(j, '$.context[*]')) e, generate_subscripts(json_extract(j, '$.context[*]'), 1) - 1 cp FROM r WHERE json_type(j, '$.context') = 'ARRAY'),
rc2 AS (SELECT row_id, cp, {_ENTRY('e', 'title')} t, {_ENTRY('e', 'sentences')} s FROM rc),
rf AS (SELECT row_id, unnest(json_extract(j, '$.supporting_facts[*]')) e, generate_subscripts(json_extract(j, '$.supporting_facts[*]'), 1) - 1 fp FROM r WHERE json_type(j, '$.supporting_facts') = 'ARRAY'),
rf2 AS (SELECT row_id, fp, {_ENTRY('e', 'title')} t, {_ENTRY('e', 'sentence_index')} i FROM rf),
c AS (SELECT row_id, cp, {_S(_TEXT('t'))} t, list_transform(json_extract(s, '$[*]'), lambda x: {_TEXT('x')}) s FROM rc2 WHERE json_type(s) = 'ARRAY'
 UNION ALL SELECT row_id, cp, {_S('c.title')}, c.sentences FROM (SELECT row_id, unnest(contexts) c, generate_subscripts(contexts, 1) - 1 cp FROM examples)),
f AS (SELECT row_id, fp, {_S(_TEXT('t'))} t, CASE WHEN json_type(i) IN ('UBIGINT', 'BIGINT') THEN i::VARCHAR::BIGINT WHEN regexp_matches({_S(_TEXT('i'))}, '^[+-]?[0-9]{{1,18}}$') THEN {_S(_TEXT('i'))}::BIGINT END i FROM rf2
 UNION ALL SELECT row_id, fp, {_S('f.title')}, f.sentence_index::BIGINT FROM (SELECT row_id, unnest(supporting_facts) f, generate_subscripts(supporting_facts, 1) - 1 fp FROM examples))
SELECT f.row_id, fp fact_pos, cp context_pos, i sentence_pos FROM f JOIN c ON c.row_id = f.row_id AND c.t = f.t WHERE f.t <> '' AND i >= 0 AND i < len(s) AND s[i + 1] IS NOT NULL"""

_KIND = lambda j: f"CASE json_type({j}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_PLAIN = lambda j: f"CASE WHEN json_type({j}) = 'VARCHAR' THEN json_extract_string({j}, '$') WHEN json_type({j}) <> 'NULL' THEN {j}::VARCHAR END"
#: Some key of an object has a value that isn't null and that ``held`` (of key k and value v) doesn't cover.
_LEFT = lambda o, held: f"len(list_filter(json_keys({o}), lambda k: coalesce(json_type(json_extract({o}, '$.\"' || k || '\"')), 'NULL') <> 'NULL' AND NOT ({held(f'json_type(json_extract({o}, chr(36) || chr(46) || chr(34) || k || chr(34)))')}))) > 0"
_RAW = "r AS (SELECT row_id, j FROM (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END j FROM raw_examples) WHERE json_type(j) = 'OBJECT')"
_SOME = lambda *keys: "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') <> 'NULL' THEN '{k}' END" for k in keys) + ")"
_HELD = {c: _SOME(*keys) for c, keys in nested.KEYS.items()}
_VALUE = lambda c: _PLAIN(f"json_extract(j, '$.' || {_HELD[c]})")
_RAW_LISTS = f"""{_RAW}, rc AS (SELECT row_id, unnest(l) e, generate_subscripts(l, 1) - 1 pos FROM (SELECT row_id, CASE {_SOME('context', 'contexts')} WHEN 'context' THEN json_extract(j, '$.context[*]') ELSE json_extract(j, '$.contexts[*]') END l FROM r WHERE json_type(j, '$.' || {_SOME('context', 'contexts')}) = 'ARRAY')),
rcs AS (SELECT *, row_id || '/context/' || pos pk, CASE WHEN json_type(e) = 'ARRAY' AND json_array_length(e) = 2 THEN 'array' WHEN json_type(e) = 'OBJECT' AND json_exists(e, '$.title') THEN 'object' ELSE 'odd' END kind, {_ENTRY('e', 'title')} t, {_ENTRY('e', 'sentences')} s FROM rc),
rf AS (SELECT row_id, unnest(l) e, generate_subscripts(l, 1) - 1 pos FROM (SELECT row_id, json_extract(j, '$.supporting_facts[*]') l FROM r WHERE json_type(j, '$.supporting_facts') = 'ARRAY')),
rfs AS (SELECT *, row_id || '/fact/' || pos pk, CASE WHEN json_type(e) = 'ARRAY' AND json_array_length(e) = 2 THEN 'array' WHEN json_type(e) = 'OBJECT' AND json_exists(e, '$.title') THEN 'object' ELSE 'odd' END kind, {_ENTRY('e', 'title')} t, {_ENTRY('e', 'sentence_index')} i FROM rf),
ec AS (SELECT row_id, c, pos, row_id || '/context/' || pos pk FROM (SELECT row_id, unnest(contexts) c, generate_subscripts(contexts, 1) - 1 pos FROM examples)),
ef AS (SELECT row_id, f, pos, row_id || '/fact/' || pos pk FROM (SELECT row_id, unnest(supporting_facts) f, generate_subscripts(supporting_facts, 1) - 1 pos FROM examples))"""
_REST_TOP = f"len(list_filter(json_keys(j), lambda k: json_type(j, '$.\"' || k || '\"') <> 'NULL' AND NOT (json_type(j, '$.\"' || k || '\"') = 'VARCHAR' AND list_contains([{', '.join(_HELD.values())}], k)) AND NOT (json_type(j, '$.\"' || k || '\"') = 'ARRAY' AND list_contains([{_SOME('context', 'contexts')}, 'supporting_facts'], k)))) > 0"
_LINKS = f"SELECT row_id record, row_id || '/fact/' || fact_pos || '/link/' || context_pos pk, row_id || '/fact/' || fact_pos parent_pk, context_pos pos, 'pointer' kind, row_id || '/context/' || context_pos || '/sentence/' || sentence_pos title, fact_pos, sentence_pos FROM ({_P1})"

# Kinds of a value, inside arrays with their depth; empty values have none.
_FULL = lambda j: f"(json_type({j}) <> 'NULL' AND {j}::VARCHAR NOT IN ('\"\"', '[]', '{{}}'))"
_KINDS = f"""list_sort(list_distinct(list_concat(CASE WHEN {_FULL('v')} THEN [{_KIND('v')}] ELSE [] END,
 list_transform(list_filter(json_extract(v, '$[*]'), lambda x: {_FULL('x')}), lambda x: '[' || {_KIND('x')}), list_transform(list_filter(json_extract(v, '$[*][*]'), lambda x: {_FULL('x')}), lambda x: '[[' || {_KIND('x')}), list_transform(list_filter(json_extract(v, '$[*][*][*]'), lambda x: {_FULL('x')}), lambda x: '[[[' || {_KIND('x')}))))"""
_BARE = lambda c: rf"""lower(regexp_replace({c}, '[\s"\[\]{{}}.,\\]+', '', 'g'))"""
_P2 = f"""WITH r AS (SELECT run_name, file_no, question_id, row_number() OVER () rid, j FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END j FROM raw_predictions) WHERE json_type(j) = 'OBJECT'),
files AS (SELECT run_name, file_no, min(file_name) file_name FROM raw_predictions GROUP BY ALL), pairs AS (SELECT b.* FROM files a JOIN files b ON b.run_name = a.run_name AND b.file_no = a.file_no + 1),
top AS (SELECT run_name, file_no, question_id, rid, '' a, k f, json_extract(j, '$."' || k || '"') v FROM (SELECT *, unnest(json_keys(j)) k FROM r)),
parts AS (SELECT * FROM top UNION ALL SELECT run_name, file_no, question_id, rid, f, k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) k FROM top WHERE json_type(v) = 'OBJECT')),
p AS (SELECT * EXCLUDE v, {_KINDS} k, CASE WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(json_keys(v)), ',') WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE v::VARCHAR END c FROM parts),
per AS (SELECT run_name, file_no, a, f, list_sort(list_distinct(flatten(list(k)))) k FROM p GROUP BY ALL),
b AS (SELECT coalesce(o.run_name, n.run_name) run_name, coalesce(o.file_no + 1, n.file_no) file_no, coalesce(o.a, n.a) a, coalesce(o.f, n.f) f, o.k old_k, n.k new_k FROM per o FULL JOIN per n ON o.run_name = n.run_name AND o.file_no + 1 = n.file_no AND o.a = n.a AND o.f = n.f),
both_ AS (SELECT b.*, file_name FROM b JOIN pairs USING (run_name, file_no)),
seen AS (SELECT * FROM both_ WHERE a = '' UNION ALL SELECT i.* FROM both_ i JOIN both_ o ON i.run_name = o.run_name AND i.file_no = o.file_no AND o.a = '' AND o.f = i.a WHERE i.a <> '' AND list_contains(o.old_k, 'object') AND list_contains(o.new_k, 'object')),
maybe AS (SELECT g.run_name, g.file_no, g.a, g.f gone, n.f come FROM seen g JOIN seen n ON g.run_name = n.run_name AND g.file_no = n.file_no AND g.a = n.a WHERE g.new_k IS NULL AND n.old_k IS NULL AND list_has_any(g.old_k, n.new_k)),
vals AS (SELECT run_name, file_no, question_id, a, f, max(c) c FROM p WHERE len(k) > 0 GROUP BY ALL),
score AS (SELECT m.run_name, m.file_no, m.a, gone, come, avg((o.c = n.c OR {_BARE('o.c')} = {_BARE('n.c')})::INT) share FROM maybe m JOIN vals o ON o.run_name = m.run_name AND o.file_no = m.file_no - 1 AND o.a = m.a AND o.f = m.gone JOIN vals n ON n.run_name = m.run_name AND n.file_no = m.file_no AND n.a = m.a AND n.f = m.come AND n.question_id = o.question_id GROUP BY ALL HAVING share >= {drift.RENAME_SHARE}),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY run_name, file_no, a, gone ORDER BY share DESC, come) = 1), ren AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY run_name, file_no, a, come ORDER BY share DESC, gone) = 1),
found AS (SELECT file_name, 'type_changed' change, a, f, '' g FROM seen WHERE len(old_k) > 0 AND len(new_k) > 0 AND old_k <> new_k
UNION ALL SELECT file_name, 'removed', a, f, '' FROM seen WHERE new_k IS NULL AND (run_name, file_no, a, f) NOT IN (SELECT (run_name, file_no, a, gone) FROM ren)
UNION ALL SELECT file_name, 'added', a, f, '' FROM seen WHERE old_k IS NULL AND (run_name, file_no, a, f) NOT IN (SELECT (run_name, file_no, a, come) FROM ren)
UNION ALL SELECT file_name, 'renamed', a, gone, come FROM ren JOIN files USING (run_name, file_no))
SELECT file_name, change, CASE WHEN a = '' THEN f ELSE a || '.' || f END field, CASE WHEN a = '' OR g = '' THEN g ELSE a || '.' || g END new_field FROM found"""


def _uniform_sql() -> str:
    """Values of each column under its own or an approved name (a record of the tables uses one of them)."""
    names = {t: [t, *(a for a, c in ALIASES.items() if c == t)] for t in drift.TARGET}
    at = lambda n: f"json_extract(j, '$.{n}')"
    text = lambda v: f"CASE json_type({v}) WHEN 'VARCHAR' THEN json_extract_string({v}, '$') WHEN 'ARRAY' THEN CASE WHEN json_array_length({v}) = 1 AND json_type({v}, '$[0]') = 'VARCHAR' THEN json_extract_string({v}, '$[0]') END WHEN 'OBJECT' THEN CASE WHEN len(json_keys({v})) = 1 AND json_type(json_extract({v}, '$.*')[1]) = 'VARCHAR' THEN json_extract_string(json_extract({v}, '$.*')[1], '$') END WHEN 'NULL' THEN NULL ELSE {v}::VARCHAR END"
    whole = lambda x: f"json_type({x}) IN ('UBIGINT', 'BIGINT')"
    one = lambda x, n, key: f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[{n}]') ELSE json_extract({x}, '$.{key}') END"
    first = lambda parts: f"coalesce({', '.join(parts)})"
    number = lambda v: f"CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {v}::VARCHAR::DOUBLE WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({v}, '$') AS DOUBLE) END"
    columns, exact = [], []
    for t, ns in names.items():
        if t == "sp":
            facts = first([f"CASE WHEN json_type({at(n)}) = 'ARRAY' THEN {at(n)} END" for n in ns])
            title, index = one("x", 0, "title"), one("x", 1, "sentence_index")
            columns.append(f"coalesce(array_to_string(list_transform(json_extract({facts}, '$[*]'), lambda x: json_extract_string({title}, '$') || '::' || json_extract_string({index}, '$')::BIGINT), '|'), CASE WHEN {facts} IS NOT NULL THEN '' END) sp")
            exact += [f"WHEN k = '{n}' THEN json_type({at(n)}) = 'ARRAY' AND len(list_filter(json_extract({at(n)}, '$[*]'), lambda x: json_type(x) <> 'ARRAY' OR NOT {whole(one('x', 1, 'i'))})) = 0" for n in ns]
        elif t in drift.INNER:
            for c, how in drift.INNER[t].items():
                inner = [f"json_extract(j, '$.{n}.{c}')" for n in ns]
                columns.append(first([f"CASE WHEN json_type({v}) = 'BOOLEAN' THEN {v}::VARCHAR::BOOLEAN END" for v in inner] if how == "boolean" else [number(v) for v in inner]) + (f"::INT {c}" if how == "int" else f" {c}"))
            fits = lambda n: " AND ".join([f"len(list_filter(json_keys({at(n)}), lambda y: NOT list_contains([{', '.join(repr(c) for c in drift.INNER[t])}], y))) = 0", *(f"coalesce(json_type(j, '$.{n}.{c}'), 'BOOLEAN') = 'BOOLEAN'" if how == "boolean" else f"coalesce(json_type(j, '$.{n}.{c}'), 'DOUBLE') IN ('DOUBLE', 'BIGINT', 'UBIGINT')" for c, how in drift.INNER[t].items())])
            exact += [f"WHEN k = '{n}' THEN json_type({at(n)}) = 'OBJECT' AND {fits(n)}" for n in ns]
        else:
            columns.append(first([text(at(n)) for n in ns]) + f" {t}")
            exact += [f"WHEN k = '{n}' THEN json_type({at(n)}) = 'VARCHAR'" for n in ns]
    return f"""WITH r AS (SELECT row_id, run_name, file_no, question_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END j FROM raw_predictions)
SELECT row_id, run_name, file_no, question_id, j IS NOT NULL _readable, {', '.join(columns)}, coalesce(array_to_string(list_sort(list_filter(json_keys(j), lambda k: NOT CASE {' '.join(exact)} ELSE false END)), ','), '') rescued FROM r"""


SQL = {
    "p1_found": _P1,
    "p1_links": _LINKS,
    "p1_records": f"""WITH {_RAW} SELECT row_id record, row_id::VARCHAR pk, NULL::VARCHAR parent_pk, 0::BIGINT pos, 'object' kind, NULL::VARCHAR title, {', '.join(f'{_VALUE(c)} "{c}"' for c in nested.KEYS)}, {_REST_TOP} has_rest FROM r
UNION ALL SELECT row_id, row_id::VARCHAR, NULL, 0, 'object', NULL, id, question, answer, question_type, question_level, false FROM examples""",
    "p1_contexts": f"""WITH {_RAW_LISTS} SELECT row_id record, pk, row_id::VARCHAR parent_pk, pos, kind, {_TEXT('t')} title, CASE WHEN kind = 'object' THEN {_PLAIN("json_extract(e, '$.passage_id')")} END passage_id,
CASE kind WHEN 'odd' THEN json_type(e) <> 'NULL' AND e::VARCHAR <> '{{}}' WHEN 'array' THEN json_type(t) NOT IN ('NULL', 'VARCHAR') OR json_type(s) NOT IN ('NULL', 'ARRAY') ELSE {_LEFT('e', lambda v: f"(k IN ('title', 'passage_id') AND {v} = 'VARCHAR') OR (k = 'sentences' AND {v} = 'ARRAY')")} END has_rest FROM rcs
UNION ALL SELECT row_id, pk, row_id::VARCHAR, pos, CASE WHEN c IS NULL THEN 'odd' ELSE 'object' END, c.title, c.passage_id, false FROM ec""",
    "p1_sentences": f"""WITH {_RAW_LISTS}, s AS (SELECT row_id, pk, unnest(json_extract(s, '$[*]')) x, generate_subscripts(json_extract(s, '$[*]'), 1) - 1 pos FROM rcs WHERE json_type(s) = 'ARRAY')
SELECT row_id record, pk || '/sentence/' || pos pk, pk parent_pk, pos, {_KIND('x')} kind, NULL::VARCHAR title, {_PLAIN('x')} "text" FROM s
UNION ALL SELECT row_id, pk || '/sentence/' || pos, pk, pos, CASE WHEN x IS NULL THEN 'null' ELSE 'string' END, NULL, x FROM (SELECT row_id, pk, unnest(c.sentences) x, generate_subscripts(c.sentences, 1) - 1 pos FROM ec)""",
    "p1_facts": f"""WITH {_RAW_LISTS} SELECT row_id record, pk, row_id::VARCHAR parent_pk, pos, kind, {_TEXT('t')} title, {_PLAIN('i')} sentence_index, CASE WHEN i IS NULL THEN 'null' WHEN json_type(i) = 'DOUBLE' THEN 'real' ELSE {_KIND('i')} END index_kind,
CASE kind WHEN 'odd' THEN json_type(e) <> 'NULL' AND e::VARCHAR <> '{{}}' WHEN 'array' THEN json_type(t) NOT IN ('NULL', 'VARCHAR') ELSE {_LEFT('e', lambda v: f"(k = 'title' AND {v} = 'VARCHAR') OR k = 'sentence_index'")} END has_rest FROM rfs
UNION ALL SELECT row_id, pk, row_id::VARCHAR, pos, CASE WHEN f IS NULL THEN 'odd' ELSE 'object' END, f.title, f.sentence_index::VARCHAR, CASE WHEN f.sentence_index IS NULL THEN 'null' ELSE 'number' END, false FROM ef""",
    "p2_found": _P2,
    "p2_uniform": _uniform_sql(),
}
