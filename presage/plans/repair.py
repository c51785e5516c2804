"""Damaged extraction records written from the events, and read leniently."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.operators import repair as R
from presage.plans.registry import Registry
from presage.session import table

Q = Registry()

_TEXT = "chr(34) || replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || chr(34)"
_WRAP = """'{{"properties":' || {0} || '}}'"""


def _choice(index: str, values) -> str:
    return f"CASE {index} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


#: Expressions both engines read alike, one upon the other: a confidence, a prediction and a record per event, some wrapped, quoted, cut or wrong.
LAYERS = (
    ("c", _choice("event_id", ('{"level":"high","trap":"negation"}', '{"level":"sure"}', '{"level":"low"}', '{"level":"low","trap":"other"}', '{"trap":"negation"}', '{"level":"medium","trap":null}'))),
    ("p", f"""'{{"quote":"q","stance":' || CASE k % 5 WHEN 0 THEN '"0.' || k || '"' WHEN 1 THEN '"strong"' WHEN 2 THEN 'null' WHEN 3 THEN '[0.5]' ELSE '0.' || k END
      || ',"certainty":0.' || k || ',"tone":' || {_choice('event_id', ('"alarm"', '"worried"', '["alarm"]', 'null', '"neutral"', '1'))}
      || ',"evidence_class":' || {_choice('user_id', ('"opinion"', '"official_statement"', '"reporting"'))}
      || ',"reader_confidence":' || CASE WHEN k % 3 = 0 THEN {_TEXT.format('c')} WHEN k % 19 = 4 THEN '"surely"' ELSE c END || '}}'"""),
    ("p", f"CASE WHEN user_id % 4 = 0 THEN {_WRAP.format('p')} ELSE p END"),
    ("p", f"CASE WHEN event_id % 17 = 9 THEN '\"quote only\"' WHEN event_id % 5 = 0 THEN {_TEXT.format('p')} ELSE p END"),
    ("raw", f"""'{{"consensus_view":' || {_choice('k', ('"divided"', '"levels"', 'null', '"expects_no"'))} || ',"predictions":' || CASE WHEN event_id % 13 = 5 THEN '"none"' ELSE '[' || p || ']' END || '}}'"""),
    ("raw", f"CASE WHEN event_id % 7 = 0 THEN {_WRAP.format('raw')} ELSE raw END"),
    ("raw", "CASE WHEN event_id % 11 = 3 THEN substr(raw, 1, 40) ELSE raw END"),
)


def _records_sql() -> str:
    out, seen = "SELECT event_id, user_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events", set()
    for name, expr in LAYERS:
        out = f"SELECT * REPLACE ({expr} AS {name}) FROM ({out})" if name in seen else f"SELECT *, {expr} AS {name} FROM ({out})"
        seen.add(name)
    return f"SELECT event_id, raw FROM ({out})"


def _unwrap_sql(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'OBJECT' AND json_keys({x}) = ['properties'] AND json_type({x}, '$.properties') = 'OBJECT' THEN {x}->'$.properties' ELSE {x} END"


def _reparse_sql(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CASE WHEN json_type(({x}->>'$')::JSON) = 'OBJECT' THEN ({x}->>'$')::JSON ELSE {x} END ELSE {x} END"


def _held(path: str, of: str = "q") -> str:
    return f"coalesce(json_type({of}, '$.{path}'), 'NULL') <> 'NULL'"


def _word_sql(path: str, name: str, of: str = "q") -> str:
    return f"CASE WHEN json_type({of}, '$.{path}') = 'VARCHAR' AND {of}->>'$.{path}' IN {R.ALLOWED[name]} THEN {of}->>'$.{path}' END"


def _number_sql(path: str) -> str:
    return f"CASE WHEN json_type(q, '$.{path}') NOT IN ('ARRAY', 'OBJECT') THEN TRY_CAST(q->>'$.{path}' AS DOUBLE) END"


READ_SQL = f"""WITH records AS ({_records_sql()}),
v0 AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM records), v1 AS (SELECT event_id, j, {_unwrap_sql('j')} AS v FROM v0),
v2 AS (SELECT *, coalesce(json_type(v), '') = 'OBJECT' AS rec, coalesce(json_type(v, '$.predictions'), '') = 'ARRAY' AS listed FROM v1),
v3 AS (SELECT *, CASE WHEN listed THEN v->'$.predictions[0]' END AS p FROM v2), v4 AS (SELECT *, {_reparse_sql('p')} AS p1 FROM v3), v5 AS (SELECT *, {_unwrap_sql('p1')} AS q FROM v4),
v6 AS (SELECT *, coalesce(json_type(q), '') = 'OBJECT' AS obj, q->'$.reader_confidence' AS n FROM v5), v7 AS (SELECT *, {_reparse_sql('n')} AS c FROM v6),
v8 AS (SELECT *, {_word_sql('consensus_view', 'consensus_view', 'v')} AS consensus_view, {_number_sql('stance')} AS stance, {_number_sql('certainty')} AS certainty,
   {_word_sql('tone', 'tone')} AS tone, {_word_sql('evidence_class', 'evidence_class')} AS evidence_class, {_word_sql('level', 'level', 'c')} AS lv, {_word_sql('trap', 'trap', 'c')} AS tr FROM v7),
read AS (SELECT *, lv IS NOT NULL AND NOT ({_held('trap', 'c')} AND tr IS NULL) AS sure FROM v8)"""

_FAULTS = {"record": "NOT rec", "predictions": "rec AND NOT listed", "prediction": "listed AND NOT obj", "consensus_view": _held("consensus_view", "v") + " AND consensus_view IS NULL",
           "stance": _held("stance") + " AND stance IS NULL", "certainty": _held("certainty") + " AND certainty IS NULL", "tone": _held("tone") + " AND tone IS NULL",
           "evidence_class": _held("evidence_class") + " AND evidence_class IS NULL", "reader_confidence": "coalesce(json_type(n), 'NULL') <> 'NULL' AND NOT sure"}
_MENDED = {"record": "rec AND v <> j", "prediction": "obj AND q <> p", "stance": "json_type(q, '$.stance') = 'VARCHAR' AND stance IS NOT NULL",
           "certainty": "json_type(q, '$.certainty') = 'VARCHAR' AND certainty IS NOT NULL", "reader_confidence": "json_type(n) = 'VARCHAR' AND sure"}


def _names_sql(tests: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "], lambda x: x IS NOT NULL), ',')"


def predictions(spark, sf):
    raw = table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    for name, expr in LAYERS:
        raw = raw.withColumn(name, F.expr(expr))
    return R.repaired_predictions(raw, "event_id", "raw", words=("tone", "evidence_class"))


@Q.add("repaired_extractions", READ_SQL + f"""
SELECT event_id, consensus_view, stance, certainty, tone, evidence_class, CASE WHEN sure THEN lv END AS level, CASE WHEN sure THEN tr END AS trap,
       {_names_sql(_FAULTS)} AS faults, {_names_sql(_MENDED)} AS mended FROM read""")
def repaired_extractions(spark, sf):
    """Every prediction with its fields, those given up, and those read in spite of damage."""
    p = predictions(spark, sf)
    return p.select("event_id", "consensus_view", "stance", "certainty", "tone", "evidence_class", "reader_confidence.level", "reader_confidence.trap",
                    F.array_join("faults", ",").alias("faults"), F.array_join("mended", ",").alias("mended"))


@Q.add("extraction_faults", READ_SQL + f"""
SELECT field, count(*) FILTER (WHERE bad) AS given_up, count(*) FILTER (WHERE good) AS mended, count(*) AS predictions FROM (
  SELECT unnest(list_transform({list(_FAULTS)}, lambda f: {{'field': f, 'bad': list_contains(string_split(b, ','), f), 'good': list_contains(string_split(m, ','), f)}}), recursive := true)
  FROM (SELECT {_names_sql(_FAULTS)} AS b, {_names_sql(_MENDED)} AS m FROM read)) GROUP BY 1""")
def extraction_faults(spark, sf):
    """Per field: in how many predictions it was given up or mended."""
    each = predictions(spark, sf).select("faults", "mended", F.explode(F.lit(list(_FAULTS))).alias("field"))
    return each.groupBy("field").agg(F.count_if(F.array_contains("faults", F.col("field"))).alias("given_up"), F.count_if(F.array_contains("mended", F.col("field"))).alias("mended"),
                                     F.count(F.lit(1)).alias("predictions"))
