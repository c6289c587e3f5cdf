"""Assessment-shaped views over the shared tables.

The shared tables hold no rubric data, so votes, human labels, responses,
programs and statements are derived from ``events`` and ``documents`` by fixed
expressions. An expression valid in Spark and DuckDB is written once; ``CTES``
holds the DuckDB side. Groups are made of consecutive event ids (24 events per
student, 4 rows per answer), so their size is fixed whatever the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.dims import LESSONS, RUN_KEY, STUDENT_KEY, VALID_LABELS
from tallymark.operators import features
from tallymark.operators.consensus import consensus
from tallymark.operators.rules import RULES

CTES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefix a query with the views it uses, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH {parts}\n{body}"


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _case(on: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {on} {whens} END"


RUN = ", ".join(RUN_KEY)
STUDENT = ", ".join(STUDENT_KEY)

# ---- votes of users: long table, groups as large as a user is active --------

LABEL = (
    "CASE event_type WHEN 'click' THEN 'Extensive Evidence' WHEN 'purchase' THEN 'Convincing Evidence' "
    "WHEN 'view' THEN 'Limited Evidence' WHEN 'signup' THEN 'No Evidence' ELSE 'invalid label' END"
)
VOTES = {
    "dataset": "'d' || (user_id % 2)",
    "experiment": "'e' || (user_id % 3)",
    "lesson": "'L' || (user_id % 7)",
    "student_id": "'student_' || user_id",
    "key_concept": "'KC' || (event_id % 4)",
    "choice_index": "event_id",
    "row_index": "CAST(0 AS BIGINT)",
    "label": LABEL,
    "observations": "'obs ' || event_id",
    "evidence": "'Lines ' || (event_id % 90) || ', ' || (event_id % 90 + 1) || ', ' || (event_id % 90 + 2) || ': x'",
    "reason": "'r ' || event_id",
    "value": "value",
}
CTES["votes"] = _select(VOTES, "events")
GROUP = f"{STUDENT}, key_concept"
CTES["tally"] = (
    f"SELECT {GROUP}, label, count(*) AS n, min(choice_index) AS f, max(choice_index) AS l "
    f"FROM votes GROUP BY {GROUP}, label"
)
CTES["winner"] = (
    f"SELECT {GROUP}, arg_max(label, struct_pack(n := n, f := -f)) AS label, arg_min(label, f) AS first_label, "
    f"min(f) AS first_choice, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS n_votes FROM tally GROUP BY {GROUP}"
)
CTES["vote_text"] = (
    f"SELECT {GROUP}, string_agg(label, ', ' ORDER BY choice_index) AS seq FROM votes GROUP BY {GROUP}"
)
CTES["voted"] = f"""SELECT w.*, a.observations, a.evidence,
  CASE WHEN w.n_labels > 1 THEN '<b>Votes: [' || s.seq || ']</b><br>' ELSE '' END || z.reason AS reason
  FROM winner w JOIN tally t USING ({GROUP}, label)
  JOIN votes a ON a.choice_index = t.f JOIN votes z ON z.choice_index = t.l
  JOIN vote_text s USING ({GROUP})"""
CTES["actual"] = f"""SELECT {GROUP}, arg_max(CASE label WHEN 'invalid label' THEN 'Limited Evidence' ELSE label END,
  struct_pack(v := value, c := choice_index)) AS label FROM votes GROUP BY {GROUP}"""
CTES["matched"] = f"""SELECT p.{', p.'.join(STUDENT_KEY)}, p.key_concept, p.observations, p.evidence, p.reason,
  p.label AS predicted, a.label AS actual FROM voted p JOIN actual a USING ({GROUP})"""
_PASS = "'Extensive Evidence/Convincing Evidence'"
_FAIL = "'Limited Evidence/No Evidence'"


def duck_pass(label: str) -> str:
    return (
        f"CASE WHEN {label} IN ('Extensive Evidence', 'Convincing Evidence') THEN {_PASS} ELSE {_FAIL} END"
    )


CTES["moded"] = f"""SELECT {GROUP}, 'pass_fail' AS mode, {duck_pass('actual')} AS actual,
  {duck_pass('predicted')} AS predicted FROM matched
  UNION ALL SELECT {GROUP}, 'exact', actual, predicted FROM matched"""
CTES["acc"] = f"""SELECT {RUN}, mode, key_concept, grouping(key_concept) = 1 AS overall, count(*) AS n,
  avg(CAST(actual = predicted AS INT)) AS accuracy
  FROM moded GROUP BY GROUPING SETS (({RUN}, mode, key_concept), ({RUN}, mode))"""
_SCALE = ", ".join(f"('exact', '{x}')" for x in VALID_LABELS)
CTES["scale"] = f"SELECT * FROM (VALUES {_SCALE}, ('pass_fail', {_PASS}), ('pass_fail', {_FAIL})) AS t(mode, label)"
CTES["confused"] = f"""SELECT g.*, a.label AS actual, p.label AS predicted, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT {RUN}, mode, key_concept FROM moded) g
  JOIN scale a ON a.mode = g.mode JOIN scale p ON p.mode = g.mode
  LEFT JOIN (SELECT {RUN}, mode, key_concept, actual, predicted, count(*) AS n FROM moded GROUP BY ALL) c
  ON c.dataset = g.dataset AND c.experiment = g.experiment AND c.lesson = g.lesson AND c.mode = g.mode
  AND c.key_concept = g.key_concept AND c.actual = a.label AND c.predicted = p.label"""
CTES["class_stats"] = f"""SELECT {RUN}, mode, key_concept, predicted AS label, CAST(sum(n) AS BIGINT) AS n,
  coalesce(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / nullif(sum(n), 0), 0) AS prec
  FROM confused GROUP BY {RUN}, mode, key_concept, predicted"""
CTES["thresholds"] = """SELECT 'L' || l AS lesson, CASE WHEN k < 3 THEN 'KC' || k END AS key_concept,
  0.2 + 0.01 * l + 0.05 * k AS min_accuracy
  FROM (SELECT DISTINCT user_id % 7 AS l FROM events WHERE user_id % 7 < 6) CROSS JOIN range(4) AS r(k)"""

# ---- students of 24 consecutive events: answers, programs, statements -------

_SID = "CAST(floor(event_id / 24) AS BIGINT)"
_FIRST_RULE = [next(r.key_concept for r in RULES.values() if r.lesson == lesson) for lesson in LESSONS]


def _concept_name() -> str:
    """Concept k of a lesson: its rules' concepts first, then plain names."""
    whens = []
    for i, lesson in enumerate(LESSONS):
        for k, rule in enumerate([r for r in RULES.values() if r.lesson == lesson]):
            whens.append(f"WHEN sid % 7 = {i} AND k = {k} THEN '{rule.key_concept}'")
    return f"CASE {' '.join(whens)} ELSE 'Concept ' || k END"


BASE = {
    "sid": _SID,
    "event_id": "event_id",
    "k": "event_id % 4",
    "choice": "CAST(floor(event_id / 4) AS BIGINT) % 6",
    "pos": "event_id % 24",
    "a": "user_id % 5",
    "s": f"(user_id + {_SID}) % 8",
    "label": LABEL,
    "props": "props",
}
CTES["base"] = _select(BASE, "events")
IDS = {
    "dataset": "'d' || (sid % 2)",
    "experiment": "'e' || (sid % 3)",
    "lesson": _case("sid % 7", LESSONS),
    "student_id": "'student_' || sid",
}
ANSWERS = {
    **IDS,
    "sid": "sid",
    "k": "k",
    "choice": "choice",
    "fmt": "CASE WHEN sid % 3 = 0 THEN 'json' WHEN floor(sid / 3) % 3 = 0 THEN 'tsv' WHEN floor(sid / 3) % 3 = 1 THEN 'csv' ELSE 'md' END",
    "variant": "sid % 11",
    "key_concept": _concept_name(),
    "observations": "'saw ' || props || ', twice'",
    "evidence": "'Lines ' || (event_id % 90) || ', ' || (event_id % 90 + 1) || ', ' || (event_id % 90 + 2) || ': x'",
    "label": "label",
    "reason": "'r ' || event_id",
}
CTES["answers"] = _select(ANSWERS, "base")
CTES["rubric"] = f"SELECT DISTINCT {RUN}, key_concept FROM answers"
CTES["answer_choice"] = f"""SELECT {STUDENT}, sid, choice, any_value(fmt) AS fmt, any_value(variant) AS variant,
  choice = max(choice) OVER (PARTITION BY sid) AS is_last,
  bool_and(label <> 'invalid label') AS labels_ok, arg_min(label, k) FILTER (label = 'invalid label') AS bad_label
  FROM answers GROUP BY {STUDENT}, sid, choice"""
CTES["choice_status"] = """SELECT *, CASE
  WHEN variant = 6 AND is_last THEN 'empty'
  WHEN variant = 0 AND choice = 0 THEN 'invalid_columns'
  WHEN variant = 1 AND choice = 1 THEN 'invalid_concepts'
  WHEN variant = 2 AND choice = 2 AND fmt = 'json' THEN 'too_large'
  WHEN variant = 4 AND choice = 0 AND fmt <> 'md' THEN 'invalid_concepts'
  WHEN variant = 7 AND choice = 1 AND fmt = 'json' THEN 'invalid_json'
  WHEN variant = 7 AND choice = 1 THEN 'invalid_concepts'
  WHEN NOT labels_ok THEN 'invalid_label' ELSE 'ok' END AS status
  FROM answer_choice WHERE variant NOT IN (8, 9)"""
CTES["outcomes"] = f"""SELECT {STUDENT}, sid, CASE any_value(variant) WHEN 8 THEN 'server_error' WHEN 9 THEN 'too_large' ELSE
  CASE WHEN bool_or(coalesce(status, '') = 'ok') THEN 'ok'
  WHEN arg_max(status, choice) = 'too_large' THEN 'too_large' ELSE 'invalid' END END AS outcome,
  count(*) FILTER (status = 'ok') AS n_ok,
  CASE WHEN any_value(variant) IN (8, 9) THEN 0 ELSE 100 * count(*) END AS total_tokens
  FROM answer_choice LEFT JOIN (SELECT sid, choice, status FROM choice_status) USING (sid, choice)
  GROUP BY {STUDENT}, sid"""
CTES["ok_votes"] = f"""SELECT a.*, o.n_ok FROM answers a JOIN choice_status c USING (sid, choice)
  JOIN outcomes o USING (sid) WHERE c.status = 'ok'"""
CTES["ok_tally"] = f"""SELECT {GROUP}, label, count(*) AS n, min(choice) AS f, max(choice) AS l
  FROM ok_votes GROUP BY {GROUP}, label"""
CTES["ok_winner"] = f"""SELECT {GROUP}, arg_max(label, struct_pack(n := n, f := -f)) AS label,
  arg_min(label, f) AS first_label, count(*) AS n_labels FROM ok_tally GROUP BY {GROUP}"""
CTES["graded"] = f"""SELECT {STUDENT}, key_concept, w.label, w.first_label, w.n_labels, x.n_ok, x.k, x.observations, x.evidence,
  CASE WHEN w.n_labels > 1 THEN '<b>Votes: [' || q.seq || ']</b><br>' ELSE '' END || y.reason AS reason
  FROM ok_winner w JOIN ok_tally t USING ({GROUP}, label)
  JOIN ok_votes x USING ({GROUP}) JOIN ok_votes y USING ({GROUP})
  JOIN (SELECT {GROUP}, string_agg(label, ', ' ORDER BY choice) AS seq FROM ok_votes GROUP BY {GROUP}) q USING ({GROUP})
  WHERE x.choice = t.f AND y.choice = t.l"""

# Programs: 24 statements each, 8 before, 12 in and 4 after the draw function.
# (region, cases of s, program line, fact, fact nested in its braces)
_OBJ, _FUN = "'o' || a", "'f' || a"


def _q(text: str) -> str:
    return f"'{text}'"


def _fact(kind: str, **parts: str) -> dict[str, str]:
    return {"kind": _q(kind), **parts}


def _set(prop: str, value: str, op: str = "=", **more: str) -> dict[str, str]:
    return _fact("assign", object=_OBJ, property=_q(prop), op=_q(op), value=value,
                 **{"counter": "false", "random": "false", **more})


_STATEMENTS = [
    ("pre", [0], f"'var ' || {_OBJ} || ' = createSprite(1, 2);'",
     _fact("declare", name=_OBJ, call=_q("createSprite"), args=_q("1, 2"), value=_q("createSprite(1, 2)")), None),
    ("pre", [1], f"'var ' || {_OBJ} || ' = 5;'", _fact("declare", name=_OBJ, value=_q("5")), None),
    ("pre", [2], f"{_OBJ} || '.setAnimation(\"k\");'",
     _fact("method", object=_OBJ, name=_q("setAnimation"), args=_q('"k"')), None),
    ("pre", [3], f"{_OBJ} || '.velocityX = 3;'", _set("velocityX", _q("3")), None),
    ("pre", [4], _q('background("blue");'), _fact("call", name=_q("background"), args=_q('"blue"')), None),
    ("pre", [5], _q("rect(1, 2, 3, 4);"), _fact("call", name=_q("rect"), args=_q("1, 2, 3, 4")), None),
    ("pre", [6], _q('text("a; {b", 1, 2);'), _fact("call", name=_q("text"), args=_q('"a; {b", 1, 2')), None),
    ("pre", [7], _q("ellipse(5, 6);"), _fact("call", name=_q("ellipse"), args=_q("5, 6")), None),
    ("draw", [0], f"{_OBJ} || '.x = ' || {_OBJ} || '.x + 1; // }}'",
     _set("x", f"{_OBJ} || '.x + 1'", counter="true"), None),
    ("draw", [1], f"{_OBJ} || '.y = randomNumber(1, 9);'",
     _set("y", _q("randomNumber(1, 9)"), random="true", call=_q("randomNumber"), args=_q("1, 9")), None),
    ("draw", [2], f"{_OBJ} || '.rotation++;'",
     _fact("update", object=_OBJ, property=_q("rotation"), op=_q("++"), counter="true"), None),
    ("draw", [3], f"'if (keyDown(\"up\")) {{ ' || {_OBJ} || '.x = ' || {_OBJ} || '.x - 2; }}'",
     _fact("if", value=_q('keyDown("up")'), trigger=_q("user")),
     _set("x", f"{_OBJ} || '.x - 2'", counter="true")),
    ("draw", [4], f"'if (' || {_OBJ} || '.x > 10) {{ ' || {_FUN} || '(); }}'",
     _fact("if", value=f"{_OBJ} || '.x > 10'", trigger=_q("object")), _fact("call", name=_FUN, args=_q(""))),
    ("draw", [5], f"'if (' || {_OBJ} || ' == 3) {{ ' || {_OBJ} || '.velocityY = 2; }}'",
     _fact("if", value=f"{_OBJ} || ' == 3'", trigger=_q("variable")), _set("velocityY", _q("2"))),
    ("draw", [6], f"{_OBJ} || '.x += 2;'", _set("x", _q("2"), op="+="), None),
    ("draw", [7], _q("line(1, 2, 3, 4);"), _fact("call", name=_q("line"), args=_q("1, 2, 3, 4")), None),
    ("post", [0, 1, 2], f"'function ' || {_FUN} || '() {{ noStroke(); }}'",
     _fact("function", name=_FUN), _fact("call", name=_q("noStroke"), args=_q(""))),
    ("post", [3, 4], f"{_FUN} || '();'", _fact("call", name=_FUN, args=_q("")), None),
    ("post", [5], _q('keyDown(((((((("up"))))))));'),
     _fact("call", name=_q("keyDown"), args=_q('((((((("up")))))))')), None),
    ("post", [6], f"'var ' || {_OBJ} || ' = createSprite(3, 4);'",
     _fact("declare", name=_OBJ, call=_q("createSprite"), args=_q("3, 4"), value=_q("createSprite(3, 4)")), None),
    ("post", [7], f"{_OBJ} || '.setAnimation(\"z\");'",
     _fact("method", object=_OBJ, name=_q("setAnimation"), args=_q('"z"')), None),
]
_FACT_TEXT = ["kind", "name", "object", "property", "op", "call", "args", "value", "trigger"]
_FACT_FLAGS = ["counter", "random"]
_REGION = "CASE WHEN pos < 8 THEN 'pre' WHEN pos < 20 THEN 'draw' ELSE 'post' END"
_LINE = "CAST(pos + CASE WHEN pos < 8 THEN 1 WHEN pos < 20 THEN 2 ELSE 3 END AS INT)"


def _statement_case(pick) -> str:
    whens = []
    for region, cases, code, main, nested in _STATEMENTS:
        value = pick(code, main, nested)
        if value is not None:
            listed = ", ".join(map(str, cases))
            whens.append(f"WHEN {_REGION} = '{region}' AND s IN ({listed}) THEN {value}")
    return f"CASE {' '.join(whens)} END" if whens else "NULL"


def _fact_columns(which: str) -> dict[str, str]:
    def part(name):
        return _statement_case(lambda code, main, nested: ((main if which == "main" else nested) or {}).get(name))

    extra = 0 if which == "main" else 5
    columns = {**IDS, "seq": f"CAST({_LINE} * 10 + {extra} AS BIGINT)"}
    columns["done"] = f"CAST({_LINE} * 10 + {9 if which == 'main' else 5} AS BIGINT)"
    columns["start"] = columns["end_line"] = _LINE
    columns |= {name: f"CAST({part(name)} AS STRING)" for name in _FACT_TEXT}
    columns |= {name: f"CAST({part(name)} AS BOOLEAN)" for name in _FACT_FLAGS}
    return columns


_MAIN, _NESTED = _fact_columns("main"), _fact_columns("nested")
_DRAW = {
    **IDS,
    "seq": "CAST(90 AS BIGINT)", "done": "CAST(229 AS BIGINT)",
    "start": "CAST(9 AS INT)", "end_line": "CAST(22 AS INT)",
    **{n: "CAST(NULL AS STRING)" for n in _FACT_TEXT},
    "kind": "'function'", "name": "'draw'",
    **{n: "CAST(NULL AS BOOLEAN)" for n in _FACT_FLAGS},
}

CTES["raw_facts"] = (
    f"{_select(_MAIN, 'base')} UNION ALL SELECT * FROM ({_select(_NESTED, 'base')}) WHERE kind IS NOT NULL "
    f"UNION ALL {_select(_DRAW, 'base')} WHERE pos = 8"
)
CTES["facts"] = f"""SELECT f.*, d.seq IS NOT NULL AND f.start >= d.start AND f.end_line <= d.end_line AND f.seq <> d.seq AS in_draw,
  d.end_line AS last_draw_line
  FROM raw_facts f LEFT JOIN (SELECT * FROM raw_facts WHERE kind = 'function' AND name = 'draw') d USING ({STUDENT})"""
CTES["shape_names"] = "SELECT unnest(['circle', 'ellipse', 'quad', 'rect', 'regularPolygon', 'shape', 'triangle']) AS name"
CTES["decl"] = f"""SELECT {STUDENT}, name AS identifier, min(seq) AS seq, arg_min(end_line, seq) AS end_line,
  arg_min(value, seq) AS value, arg_min(coalesce(args, ''), seq) AS args,
  CASE WHEN arg_min(coalesce(call, ''), seq) = 'createSprite' THEN 'sprite' WHEN arg_min(coalesce(call, ''), seq) = 'text' THEN 'text'
  WHEN arg_min(coalesce(call, ''), seq) IN (SELECT name FROM shape_names) THEN 'shape' ELSE 'none' END AS type
  FROM facts WHERE kind = 'declare' GROUP BY {STUDENT}, name"""
CTES["objects"] = f"""SELECT {STUDENT}, seq, identifier, type, end_line AS start, end_line, args FROM decl WHERE type <> 'none'
  UNION ALL SELECT {STUDENT}, seq, '', CASE WHEN name = 'background' THEN 'background' WHEN name = 'text' THEN 'text' ELSE 'shape' END,
  start, end_line, args FROM facts WHERE kind = 'call' AND (name IN ('background', 'text') OR name IN (SELECT name FROM shape_names))"""
CTES["changes"] = f"""SELECT {STUDENT}, seq, object, property, CASE WHEN kind = 'method' THEN name END AS method, start, end_line, in_draw
  FROM facts WHERE (kind IN ('assign', 'update') AND property IS NOT NULL) OR (kind = 'method' AND name = 'setAnimation')"""
CTES["moves"] = f"""SELECT f.{', f.'.join(STUDENT_KEY)}, f.seq, m.movement, f.object, f.property, f.start, f.end_line
  FROM facts f JOIN decl d ON {' AND '.join(f'd.{c} = f.{c}' for c in STUDENT_KEY)} AND d.identifier = f.object AND d.type <> 'none'
  AND d.end_line <= f.last_draw_line
  JOIN (VALUES ('random'), ('counter')) AS m(movement)
  ON (m.movement = 'random' AND f.random) OR (m.movement = 'counter' AND f.counter)
  WHERE f.in_draw AND f.kind IN ('assign', 'update') AND f.property IN ('x', 'y', 'velocityX', 'velocityY', 'rotation')"""
CTES["defs"] = f"""SELECT f.{', f.'.join(STUDENT_KEY)}, f.name AS function, f.seq, f.start, f.end_line,
  CASE WHEN f.seq = min(f.seq) OVER (PARTITION BY {', '.join('f.' + c for c in STUDENT_KEY)}, f.name) THEN
  (SELECT count(*) FROM facts c WHERE c.kind = 'call' AND c.name = f.name AND {' AND '.join(f'c.{x} = f.{x}' for x in STUDENT_KEY)})
  ELSE (SELECT count(*) FROM facts c WHERE c.kind = 'call' AND c.name = f.name AND c.done < f.done
  AND {' AND '.join(f'c.{x} = f.{x}' for x in STUDENT_KEY)}) END AS calls
  FROM facts f WHERE f.kind = 'function' AND f.name <> 'draw'"""


def _count(source: str, what: str = "count(*)", where: str = "true") -> str:
    same = " AND ".join(f"x.{c} = p.{c}" for c in STUDENT_KEY)
    return f"(SELECT {what} FROM {source} x WHERE {same} AND {where})"


_SPRITE = "x.object IN (SELECT d.identifier FROM decl d WHERE d.type = 'sprite' AND " + " AND ".join(
    f"d.{c} = x.{c}" for c in STUDENT_KEY
) + ")"
_FEATURE_SQL = {
    "sprites": _count("objects", where="x.type = 'sprite'"),
    "shapes": _count("objects", where="x.type = 'shape'"),
    "texts": _count("objects", where="x.type = 'text'"),
    "counted_shapes": _count("facts", "count(DISTINCT x.name)", "x.kind = 'call' AND x.name IN ('rect', 'ellipse', 'line', 'arc', 'point', 'regularPolygon', 'shape')"),
    "sprites_updated": _count("changes", "count(DISTINCT x.object)", f"x.in_draw AND {_SPRITE}"),
    "sprites_animated": _count("changes", "count(DISTINCT x.object)", f"NOT x.in_draw AND x.method = 'setAnimation' AND {_SPRITE}"),
    "sprites_with_velocity": _count("changes", "count(DISTINCT x.object)", f"NOT x.in_draw AND x.property LIKE '%velocity%' AND {_SPRITE}"),
    "random": _count("moves", where="x.movement = 'random'"),
    "counter": _count("moves", where="x.movement = 'counter'"),
    "cond_draw": _count("facts", where="x.kind = 'if' AND x.in_draw"),
    "cond_user": _count("facts", where="x.kind = 'if' AND x.in_draw AND x.trigger = 'user'"),
    "cond_variable": _count("facts", where="x.kind = 'if' AND x.in_draw AND x.trigger = 'variable'"),
    "cond_object": _count("facts", where="x.kind = 'if' AND x.in_draw AND x.trigger = 'object'"),
    "functions": _count("defs"),
    "functions_called": _count("defs", "count(DISTINCT x.function)", "x.calls > 0"),
    "functions_called_again": _count("defs", "count(DISTINCT x.function)", "x.calls > 1"),
}
CTES["feature"] = (
    f"SELECT {', '.join('p.' + c for c in STUDENT_KEY)}, "
    + ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in _FEATURE_SQL.items())
    + f" FROM (SELECT DISTINCT {STUDENT} FROM facts) p"
)
_RULE_ROWS = ", ".join(f"('{r.key_concept}', '{r.lesson}')" for r in RULES.values())
CTES["asked"] = f"SELECT * FROM (VALUES {_RULE_ROWS}) AS t(key_concept, tree_lesson)"


# ---- Spark side -------------------------------------------------------------

# Stands for the value of ``a`` in constant tables of the statements.
_A = "\x01"


def _constant(sql: str) -> Column:
    return F.expr(sql.replace("|| a", "|| chr(1)"))


def _with_a(text: Column) -> Column:
    # Statements have an a; the draw function has none to put in.
    return F.replace(text, F.lit(_A), F.coalesce(F.col("a").cast("string"), F.lit("")))


_DRAW_PARTS = {"kind": _DRAW["kind"], "name": _DRAW["name"]}
_PLACES = {"seq": "bigint", "done": "bigint", "start": "int", "end_line": "int"}
_IN_LINE = ["seq_in_line", "done_in_line"]
_FACT_ROWS = "array<struct<%s>>" % ", ".join(
    [f"{n}: {t}" for n, t in _PLACES.items()] + [f"{n}: int" for n in _IN_LINE]
    + [f"{n}: string" for n in _FACT_TEXT] + [f"{n}: boolean" for n in _FACT_FLAGS]
)


def _fact_row(parts: dict[str, str], places: dict[str, str], seq: str = "NULL", done: str = "NULL") -> Column:
    """A fact with fixed places, or with places counted from its line."""
    return F.struct(
        *[F.expr(f"CAST({places.get(n, 'NULL')} AS {t})").alias(n) for n, t in _PLACES.items()],
        *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in zip(_IN_LINE, (seq, done))],
        *[_constant(parts.get(n, "NULL")).cast("string").alias(n) for n in _FACT_TEXT],
        *[_constant(parts.get(n, "NULL")).cast("boolean").alias(n) for n in _FACT_FLAGS],
    )


def _statement_facts(code: str, main: dict[str, str], nested: dict[str, str] | None) -> Column:
    rows = [_fact_row(main, {}, "0", "9")] + ([_fact_row(nested, {}, "5", "5")] if nested else [])
    return F.array(*rows).cast(_FACT_ROWS)


_REGIONS = ["pre", "draw", "post"]
_CASES = 8


def _of_statement(pick) -> Column:
    """What ``pick`` (code, fact, nested fact) makes of a row's statement, looked up by region and case."""
    by_place = {(r, s): (code, main, nested) for r, cases, code, main, nested in reversed(_STATEMENTS) for s in cases}
    table = F.array(*[pick(*by_place[r, s]) for r in _REGIONS for s in range(_CASES)])
    region = F.when(F.col("pos") < 8, 0).when(F.col("pos") < 20, 1).otherwise(2)
    return F.when(F.col("s").between(0, _CASES - 1), F.get(table, (region * _CASES + F.col("s")).cast("int")))


class Inputs:
    """The views as DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def votes(self) -> DataFrame:
        return _project(self.table("events"), VOTES)

    def voted(self) -> DataFrame:
        return consensus(self.votes())

    def actual(self) -> DataFrame:
        known = F.when(F.col("label") == "invalid label", "Limited Evidence").otherwise(F.col("label"))
        return self.votes().groupBy(*STUDENT_KEY, "key_concept").agg(
            F.max_by(known, F.struct("value", "choice_index")).alias("label")
        )

    def thresholds(self) -> DataFrame:
        lessons = self.table("events").select((F.col("user_id") % 7).alias("l")).distinct().where("l < 6")
        return lessons.select("l", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr(
            "'L' || l AS lesson", "CASE WHEN k < 3 THEN 'KC' || k END AS key_concept",
            "CAST(0.2 + 0.01 * l + 0.05 * k AS DOUBLE) AS min_accuracy",
        )

    # 24 events per student

    def base(self) -> DataFrame:
        return _project(self.table("events"), BASE)

    def answers(self) -> DataFrame:
        return _project(self.base(), ANSWERS)

    def responses(self) -> DataFrame:
        """Stored responses: answers written as text, some of them spoilt."""
        row = F.struct("k", "key_concept", "observations", "evidence", "label", "reason")
        per_choice = self.answers().groupBy(*STUDENT_KEY, "sid", "fmt", "variant", "choice").agg(
            F.array_sort(F.collect_list(row)).alias("rows")
        )
        per_student = per_choice.groupBy(*STUDENT_KEY, "sid", "fmt", "variant").agg(
            F.array_sort(F.collect_list(F.struct("choice", "rows"))).alias("cs")
        )
        variant = F.col("variant")

        def choice(c, i):
            text = _answer_text(c["rows"], c["choice"], F.col("fmt"), variant)
            content = F.when((variant == 6) & (i == F.size("cs") - 1), "").otherwise(text)
            return F.struct(
                F.struct(content.alias("content")).alias("message"),
                F.when((variant == 2) & (c["choice"] == 2), "length").otherwise("stop").alias("finish_reason"),
            )

        ok_body = F.to_json(
            F.struct(
                F.transform("cs", choice).alias("choices"),
                F.struct((F.size("cs") * 100).alias("total_tokens")).alias("usage"),
            )
        )
        too_long = F.lit('{"error": {"message": "too long", "code": "context_length_exceeded"}}')
        return per_student.select(
            *STUDENT_KEY,
            F.when(variant == 8, 500).when(variant == 9, 400).otherwise(200).alias("http_status"),
            F.when(variant == 8, "oops").when(variant == 9, too_long).otherwise(ok_body).alias("body"),
        )

    def rubric_levels(self) -> DataFrame:
        """Rubric of every run: its concepts with a text per label."""
        concepts = self.answers().groupBy(*RUN_KEY, "key_concept").agg(F.min("k").alias("ord"))
        labels = F.array(*[F.lit(x) for x in VALID_LABELS])
        return concepts.select("*", F.explode(labels).alias("label")).withColumn(
            "descriptor", F.concat("key_concept", F.lit(" / "), "label")
        )

    def params(self) -> DataFrame:
        runs = self.base().selectExpr("sid % 42 AS r").distinct().selectExpr(
            *[f"{e.replace('sid', 'r')} AS {n}" for n, e in IDS.items() if n != "student_id"], "r"
        )
        rules = F.array(
            *[
                F.struct(F.lit(r.lesson).alias("lesson"), F.lit(r.key_concept).alias("key_concept"))
                for r in RULES.values()
            ]
        )
        listed = F.transform(
            F.filter(rules, lambda r: r["lesson"] == F.col("lesson")), lambda r: r["key_concept"]
        )
        return runs.select(
            *RUN_KEY,
            F.lit("gpt-4-0613").alias("model"),
            F.lit(6).alias("num_responses"),
            F.lit(0.2).alias("temperature"),
            (F.col("r") % 2 == 1).alias("remove_comments"),
            F.when(F.col("r") % 3 == 0, "json").otherwise("tsv").alias("response_type"),
            listed.alias("rule_concepts"),
            F.col("lesson").alias("tree_lesson"),
        )

    def programs(self) -> DataFrame:
        """Program texts of 26 lines."""
        line = _with_a(_of_statement(lambda code, main, nested: _constant(code))).alias("line")
        lines = self.base().select(*[F.expr(e).alias(n) for n, e in IDS.items()], "sid", "pos", line)
        whole = lines.groupBy(*STUDENT_KEY, "sid").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "line"))).alias("lines")
        )

        def part(first: int, last: int):
            return F.transform(
                F.sequence(F.lit(first), F.lit(last)),
                lambda i: F.coalesce(F.try_element_at("lines", i.cast("bigint")), F.lit("")),
            )

        text = F.concat(
            part(0, 7), F.array(F.lit("function draw() {")), part(8, 19), F.array(F.lit("}")), part(20, 23)
        )
        return whole.select(*STUDENT_KEY, "sid", F.array_join(text, "\n").alias("code"))

    def submissions(self) -> DataFrame:
        """Programs, with some empty ones and some that hold a comment only."""
        code = (
            F.when(F.col("sid") % 13 == 0, "  \n\t")
            .when(F.col("sid") % 13 == 1, "// to do")
            .otherwise(F.col("code"))
        )
        return self.programs().select(*STUDENT_KEY, code.alias("code"))

    def raw_facts(self) -> DataFrame:
        """Statements as a facts table of its own, without a scan.

        A row looks its statement's facts up in a constant table: an expression with a
        branch per statement and column is too long a method for the JVM to compile.
        """
        draw = F.when(F.col("pos") == 8, F.array(_fact_row(_DRAW_PARTS, _DRAW)))
        found = F.concat(F.coalesce(_of_statement(_statement_facts), F.array().cast(_FACT_ROWS)), F.coalesce(draw, F.array().cast(_FACT_ROWS)))
        rows = self.base().withColumn("line", F.expr(_LINE)).withColumn("f", F.explode(found))
        known = lambda name: F.col(f"f.{name}")
        at_line = lambda name: (F.col("line") * 10 + known(name)).cast("bigint")
        return rows.select(
            *[F.expr(e).alias(n) for n, e in IDS.items()],
            F.coalesce(known("seq"), at_line("seq_in_line")).alias("seq"),
            F.coalesce(known("done"), at_line("done_in_line")).alias("done"),
            F.coalesce(known("start"), F.col("line")).alias("start"),
            F.coalesce(known("end_line"), F.col("line")).alias("end"),
            *[_with_a(known(name)).alias(name) for name in _FACT_TEXT],
            *[known(name).alias(name) for name in _FACT_FLAGS],
            F.lit(False).alias("seen_draw"),
        )

    def facts(self) -> DataFrame:
        return features.mark_movement_lines(features.mark_draw(self.raw_facts()))

    def requested(self) -> DataFrame:
        """Every rule asked for in the runs of its lesson."""
        params = self.params()
        return params.select(*RUN_KEY, "tree_lesson", F.explode("rule_concepts").alias("key_concept"))

    def every_rule(self) -> DataFrame:
        """Every rule asked for in every run, whatever its lesson."""
        rules = F.array(
            *[
                F.struct(F.lit(r.key_concept).alias("key_concept"), F.lit(r.lesson).alias("tree_lesson"))
                for r in RULES.values()
            ]
        )
        return self.params().select(*RUN_KEY, F.inline(rules))


def _answer_text(rows, choice, fmt, variant):
    """Rows written as json, tsv, csv or md, spoilt by variant."""
    cut = (variant == 0) & (choice == 0)
    names = ["Key Concept", "Observations", "Evidence", "Grade", "Reason"]

    def cells(r):
        concept = F.when((variant == 1) & (choice == 1) & (r["k"] == 2), F.concat(F.lit("x"), r["key_concept"])).otherwise(
            r["key_concept"]
        )
        return F.array(concept, r["observations"], r["evidence"], r["label"], r["reason"])

    junk_cells = F.array(*[F.lit(x) for x in ("-----", "-", "-", "-", "-")])
    n_junk = F.when((variant == 3) & (choice == 0), 1).when((variant == 4) & (choice == 0), 2).otherwise(0)
    body = F.concat(F.array_repeat(junk_cells, n_junk), F.transform(rows, cells))
    header = F.array(*[F.lit(n) for n in names])
    width = F.when(cut, len(names) - 1).otherwise(len(names))
    table = F.transform(F.concat(F.array(header), body), lambda cs: F.slice(cs, F.lit(1), width))

    def lines(sep: str, quote: bool = False):
        def cell(c):
            quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
            return quoted if quote else c

        return F.transform(table, lambda cs: F.array_join(F.transform(cs, cell), sep))

    def ruled(ls):
        return F.concat(F.slice(ls, 1, 1), F.array(F.lit("--- | --- | --- | --- | ---")), F.slice(ls, F.lit(2), F.size(ls)))

    objects = F.transform(
        body,
        lambda cs: F.when(
            cut, F.to_json(F.map_from_arrays(F.slice(header, 1, 4), F.slice(cs, 1, 4)))
        ).otherwise(F.to_json(F.map_from_arrays(header, cs))),
    )
    json_text = F.concat(F.lit("["), F.array_join(objects, ",\n"))
    json_text = F.when((variant == 2) & (choice == 2), json_text).otherwise(F.concat(json_text, F.lit("]")))
    # The header line of a CSV stays bare so that it can be found.
    csv_lines = F.concat(F.array(F.array_join(F.get(table, F.lit(0)), ",")), F.slice(lines(",", True), F.lit(2), F.size(table)))
    text = (
        F.when(fmt == "json", json_text)
        .when(fmt == "tsv", F.array_join(lines("\t"), "\n"))
        .when(fmt == "csv", F.array_join(csv_lines, "\n"))
        .otherwise(F.array_join(ruled(lines(" | ")), "\n"))
    )
    text = F.when(variant == 5, F.concat(F.lit("Here is the answer:\n"), text)).otherwise(text)
    return F.when(
        (variant == 7) & (choice == 1), F.when(fmt == "json", "[{]").otherwise("bogus")
    ).otherwise(text)
