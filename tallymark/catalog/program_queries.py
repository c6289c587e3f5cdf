"""Queries over programs: statements, features, rules, evidence (I, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.inputs import CTES, STUDENT, Inputs
from tallymark.catalog.registry import query
from tallymark.dims import FUNCTION_ARGS, RUN_KEY, STUDENT_KEY
from tallymark.operators import facts as scan
from tallymark.operators import features, rules
from tallymark.session import materialize


def _big(*names: str):
    return [F.col(n).cast("bigint").alias("end_line" if n == "end" else n) for n in names]


# ---- scan of program text ---------------------------------------------------

_FACT = "kind, name, object, property, op, call, args, value, trigger, counter, random, in_draw"


@query("i1_statement_scan", f"SELECT {STUDENT}, CAST(start AS BIGINT) AS start, CAST(end_line AS BIGINT) AS end_line, {_FACT} FROM facts")
def _(i):
    found = scan.facts(i.programs())
    return found.select(*STUDENT_KEY, *_big("start", "end"), *_FACT.split(", "))


# Prose has no comments; a quote ends with its line and a backtick may not end at all.
_PROSE_LINES = r"""regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '"[^"\n]*"?|''[^''\n]*''?|`[^`]*`|`[^\n]*', 'q', 'g'), '([*/%=<>&|,.])[ \t]*\n', '\1 ', 'g')"""


@query(
    "i12_unreadable_text",
    f"""SELECT 'unparsed' AS kind, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({_PROSE_LINES}, '[;{{}}\n]')) AS line FROM documents)
    WHERE regexp_matches(line, '[^\\s]') HAVING count(*) > 0""",
)
def _(i):
    """Prose is no program: its lines become unparsed rows, nothing fails."""
    prose = i.table("documents").selectExpr("doc_id", "text AS code")
    return scan.facts(prose, ["doc_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i12_restart_after_damage",
    f"SELECT {STUDENT}, CAST(start + 2 AS BIGINT) AS start, CAST(end_line + 2 AS BIGINT) AS end_line, {_FACT} FROM facts",
)
def _(i):
    """A comment, a brace and a backtick without end around every program change none of its facts."""
    damaged = F.concat(F.lit("/* no end\nfunction lost() {\n"), F.col("code"), F.lit("\n`no end"))
    found = scan.facts(i.programs().withColumn("code", damaged))
    own = found.where(~F.col("name").eqNullSafe(F.lit("lost")) & (F.col("kind") != "unparsed"))
    return own.select(*STUDENT_KEY, *_big("start", "end"), *_FACT.split(", "))


@query(
    "f3_block_ends",
    f"SELECT {STUDENT}, kind, CAST(start AS BIGINT) AS start, CAST(end_line AS BIGINT) AS end_line FROM facts WHERE kind IN ('function', 'if')",
)
def _(i):
    nested = scan.blocks(scan.statements(i.programs()))
    kinds = nested.where(F.col("block").isin("function", "if", "else_if"))
    return kinds.select(
        *STUDENT_KEY, F.when(F.col("block") == "function", "function").otherwise("if").alias("kind"),
        F.col("start").cast("bigint").alias("start"), F.col("stmt_end").cast("bigint").alias("end_line"),
    )


# ---- tables of facts --------------------------------------------------------


@query("d8_in_draw", f"SELECT {STUDENT}, seq, in_draw FROM facts")
def _(i):
    return features.mark_draw(i.raw_facts()).select(*STUDENT_KEY, "seq", "in_draw")


@query("i2_draw_range", f"SELECT {STUDENT}, CAST(9 AS BIGINT) AS draw_start, CAST(22 AS BIGINT) AS draw_end FROM raw_facts WHERE name = 'draw'")
def _(i):
    return features.draw_ranges(i.raw_facts()).select(*STUDENT_KEY, *_big("draw_start", "draw_end"))


@query("i3_objects", f"SELECT {STUDENT}, seq, identifier, type, CAST(end_line AS BIGINT) AS end_line, args FROM objects")
def _(i):
    return features.objects(i.facts()).select(*STUDENT_KEY, "seq", "identifier", "type", *_big("end"), "args")


@query("i3_variables", f"SELECT {STUDENT}, seq, identifier, value FROM decl WHERE type = 'none'")
def _(i):
    return features.variables(i.facts()).select(*STUDENT_KEY, "seq", "identifier", "value")


_ARG_VALUES = ", ".join(
    f"('{f}', {n}, '{a}')" for f, names in FUNCTION_ARGS.items() for n, a in enumerate(names, start=1)
)


@query(
    "i4_named_args",
    f"""SELECT {STUDENT}, seq, string_agg(p.name || '=' || trim(v.value), ';' ORDER BY p.place) AS named FROM
    (SELECT {STUDENT}, seq, coalesce(call, name) AS fn, unnest(string_split(replace(args, 'a; {{b', 'a; {{b'), ',')) AS value,
     generate_subscripts(string_split(args, ','), 1) AS place FROM facts WHERE kind IN ('call', 'declare') AND args <> '') v
    JOIN (VALUES {_ARG_VALUES}) AS p(fn, place, name) ON p.fn = v.fn AND p.place = v.place GROUP BY {STUDENT}, seq""",
)
def _(i):
    named = scan.named_args(F.coalesce("call", "name"), F.col("args"))
    rows = i.facts().where(F.col("kind").isin("call", "declare")).withColumn("named", named).where(F.size("named") > 0)
    shown = F.array_join(F.transform("named", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    return rows.select(*STUDENT_KEY, "seq", shown.alias("named"))


@query(
    "i5_function_calls",
    f"""SELECT {STUDENT}, seq, CASE WHEN kind = 'call' THEN name END AS function, object, CASE WHEN kind = 'method' THEN name END AS method,
    kind = 'call' AND name = 'keyDown' AS user_interaction FROM facts WHERE kind IN ('call', 'method')""",
)
def _(i):
    return features.function_calls(i.facts()).select(*STUDENT_KEY, "seq", "function", "object", "method", "user_interaction")


@query("i6_user_functions", f"SELECT {STUDENT}, function, seq, CAST(calls AS BIGINT) AS calls FROM defs")
def _(i):
    return features.user_functions(i.facts()).select(*STUDENT_KEY, "function", "seq", "calls")


@query("d9_calls_per_name", f"SELECT {STUDENT}, function, CAST(max(calls) AS BIGINT) AS calls FROM defs GROUP BY {STUDENT}, function")
def _(i):
    stats = features.name_stats(i.facts()).where("ns = 'function' AND n_defs > 0")
    return stats.select(*STUDENT_KEY, F.col("nm").alias("function"), F.col("n_calls").alias("calls"))


@query("i7_property_changes", f"SELECT {STUDENT}, seq, object, property, method, in_draw FROM changes")
def _(i):
    return features.property_changes(i.facts()).select(*STUDENT_KEY, "seq", "object", "property", "method", "in_draw")


CTES["sprite"] = "SELECT * FROM decl WHERE type = 'sprite'"


@query("d7_sprite_changes", f"SELECT {STUDENT}, c.seq, object, in_draw FROM changes c JOIN sprite s USING ({STUDENT}) WHERE s.identifier = c.object")
def _(i):
    facts = i.facts()
    sprites = features.declarations(facts).where("type = 'sprite'").select(*STUDENT_KEY, F.col("identifier").alias("object"))
    return features.property_changes(facts).join(sprites, [*STUDENT_KEY, "object"], "left_semi").select(
        *STUDENT_KEY, "seq", "object", "in_draw"
    )


@query("i8_conditionals", f"SELECT {STUDENT}, seq, value AS test, trigger, in_draw FROM facts WHERE kind = 'if'")
def _(i):
    return features.conditionals(i.facts()).select(*STUDENT_KEY, "seq", "test", "trigger", "in_draw")


@query(
    "i9_conditional_bodies",
    f"""SELECT f.{', f.'.join(STUDENT_KEY)}, f.seq, CAST(c.start AS BIGINT) AS if_start FROM facts f JOIN facts c USING ({STUDENT})
    WHERE c.kind = 'if' AND c.in_draw AND f.kind IN ('assign', 'update') AND f.start >= c.start AND f.end_line <= c.end_line""",
)
def _(i):
    inside = features.conditional_statements(i.facts()).where(F.col("kind").isin("assign", "update"))
    return inside.select(*STUDENT_KEY, "seq", F.col("if_start").cast("bigint").alias("if_start"))


@query("i10_movements", f"SELECT {STUDENT}, seq, movement, object, property FROM moves")
def _(i):
    return features.movements(i.facts()).select(*STUDENT_KEY, "seq", "movement", "object", "property")


@query(
    "d10_declared_before_draw_ends",
    f"""SELECT f.{', f.'.join(STUDENT_KEY)}, f.seq, d.end_line <= f.last_draw_line AS declared_in_time FROM facts f JOIN decl d USING ({STUDENT})
    WHERE d.identifier = f.object AND d.type <> 'none' AND f.in_draw AND f.property IS NOT NULL""",
)
def _(i):
    facts = i.facts()
    known = features.declarations(facts).where("type <> 'none'").select(
        *STUDENT_KEY, F.col("identifier").alias("object"), F.col("end").alias("declared")
    )
    changed = facts.where(F.col("in_draw") & F.col("property").isNotNull())
    return changed.join(known, [*STUDENT_KEY, "object"]).select(
        *STUDENT_KEY, "seq", (F.col("declared") <= F.col("draw_end")).alias("declared_in_time")
    )


# ---- features ---------------------------------------------------------------


def _features(i: Inputs):
    return features.program_features(features.name_stats(i.facts()))


def _feature_query(name: str, columns: list[str]) -> None:
    @query(name, f"SELECT {STUDENT}, {', '.join(columns)} FROM feature")
    def _(i):
        return _features(i).select(*STUDENT_KEY, *columns)


_feature_query("e14_object_counts", ["sprites", "shapes", "texts"])
_feature_query("e15_movement_counts", ["random", "counter"])
_feature_query("e16_distinct_names", ["counted_shapes", "sprites_updated", "sprites_animated", "sprites_with_velocity"])
_feature_query("e17_called_functions", ["functions", "functions_called", "functions_called_again"])
_feature_query("e18_draw_conditionals", ["cond_draw", "cond_user", "cond_variable", "cond_object"])


# ---- rules ------------------------------------------------------------------

_E, _C, _L, _N = ("'Extensive Evidence'", "'Convincing Evidence'", "'Limited Evidence'", "'No Evidence'")
_MOVE = "(random + counter)"
_ALL = "(shapes + sprites + texts)"
_MIX = "cond_user > 0 AND (cond_variable > 0 OR cond_object > 0)"
_LABEL_SQL = {
    "j1_l7_shapes": f"CASE WHEN counted_shapes >= 4 THEN {_E} WHEN counted_shapes = 3 THEN {_C} WHEN counted_shapes > 0 THEN {_L} ELSE {_N} END",
    "j2_l11_elements": f"CASE WHEN least(shapes, sprites, texts) >= 2 THEN {_E} WHEN least(shapes, texts) >= 1 AND sprites >= 2 THEN {_C} WHEN {_ALL} >= 2 AND texts >= 1 THEN {_L} ELSE {_N} END",
    "j3_l14_sprites": f"CASE WHEN least(sprites, sprites_updated) >= 2 THEN {_E} WHEN least(sprites, sprites_updated) >= 1 THEN {_C} WHEN sprites >= 1 THEN {_L} ELSE {_N} END",
    "j4_l14_movement": f"CASE WHEN least(shapes, sprites, texts) >= 2 AND least(random, counter) > 0 THEN {_E} WHEN least(shapes, texts) >= 1 AND sprites >= 2 AND {_MOVE} > 0 THEN {_C} WHEN {_ALL} >= 3 THEN {_L} ELSE {_N} END",
    "j5_l18_conditionals": f"CASE WHEN cond_draw >= 3 AND {_MIX} THEN {_E} WHEN cond_draw >= 2 AND {_MIX} THEN {_C} WHEN cond_draw >= 1 AND cond_user + cond_variable + cond_object >= 1 THEN {_L} ELSE {_N} END",
    "j6_l18_sprites": f"CASE WHEN least(sprites, sprites_updated) >= 3 THEN {_E} WHEN least(sprites, sprites_updated) >= 1 THEN {_C} ELSE {_L} END",
    "j7_l18_movement": f"CASE WHEN sprites >= 3 AND shapes + texts >= 1 AND least(random, counter) > 0 THEN {_E} WHEN sprites >= 2 AND shapes + texts >= 1 AND {_MOVE} > 0 THEN {_C} WHEN {_ALL} >= 1 THEN {_L} ELSE {_N} END",
    "j8_l21_sprites": f"CASE WHEN least(sprites, sprites_animated) >= 3 AND sprites_with_velocity >= 2 THEN {_E} WHEN least(sprites, sprites_animated) >= 2 AND sprites_with_velocity >= 1 THEN {_C} WHEN least(sprites, sprites_animated) >= 2 THEN {_L} ELSE {_N} END",
    "j9_l24_sprites": f"CASE WHEN least(sprites, sprites_animated) >= 4 AND sprites_with_velocity >= 2 THEN {_E} WHEN least(sprites, sprites_animated) >= 3 AND sprites_with_velocity >= 1 THEN {_C} WHEN least(sprites, sprites_animated) >= 2 THEN {_L} ELSE {_N} END",
    "j10_l28_functions": f"CASE WHEN functions >= 3 AND functions_called_again > 0 THEN {_E} WHEN functions >= 2 AND functions_called > 0 THEN {_C} WHEN functions >= 1 AND functions_called > 0 THEN {_L} ELSE {_N} END",
}
_RULE_KEYS = list(rules.RULES)
_RULE_CASES = " ".join(
    f"WHEN a.key_concept = '{concept}' AND a.tree_lesson = '{lesson}' THEN {sql}"
    for (concept, lesson), sql in zip(_RULE_KEYS, _LABEL_SQL.values())
)
# Every rule for every program, and the rules asked for in a program's own lesson.
CTES["ruled"] = f"SELECT {STUDENT}, a.key_concept, a.tree_lesson, CASE {_RULE_CASES} ELSE '' END AS label FROM feature CROSS JOIN asked a"


def _labels(i: Inputs, requested):
    return rules.label_programs(i.programs(), _features(i), requested)


def _rule_query(name: str, concept: str, lesson: str) -> None:
    @query(name, f"SELECT {STUDENT}, label FROM ruled WHERE key_concept = '{concept}' AND tree_lesson = '{lesson}'")
    def _(i):
        one = i.every_rule().where((F.col("key_concept") == concept) & (F.col("tree_lesson") == lesson))
        return _labels(i, one).select(*STUDENT_KEY, "label")


for _name, _key in zip(_LABEL_SQL, _RULE_KEYS):
    _rule_query(_name, *_key)


@query(
    "j0_rule_dispatch",
    f"""SELECT {STUDENT}, key_concept, label FROM ruled WHERE tree_lesson = lesson
    UNION ALL SELECT {STUDENT}, 'Concept 9', '' FROM feature""",
)
def _(i):
    other = i.params().select(*RUN_KEY, "tree_lesson", F.lit("Concept 9").alias("key_concept"))
    return _labels(i, i.requested().unionByName(other)).select(*STUDENT_KEY, "key_concept", "label")


# ---- evidence ---------------------------------------------------------------

_PLURAL = "CASE WHEN {0} > 1 THEN 's' ELSE '' END"


def _n(count: str, noun: str, tail: str = "") -> str:
    return f"'Code contains ' || {count} || ' {noun}' || {_PLURAL.format(count)} || '{tail}'"


_OBJ_FROM = f"objects x JOIN feature p USING ({STUDENT})"
_OTHERS = "(shapes + texts)"
_CHANGE_WHERE = "CASE WHEN in_draw THEN 'in' ELSE 'outside of' END || ' the draw loop'"
# section -> (source, filter, message)
_EVIDENCE_SQL = {
    "k2_object_types": ("object_types", _OBJ_FROM, "type <> 'background'",
        f"CASE type WHEN 'shape' THEN {_n('shapes', 'shape')} WHEN 'sprite' THEN {_n('sprites', 'sprite')} ELSE {_n('texts', 'line', ' of text')} END"),
    "k3_different_shapes": ("different_shapes", f"facts x JOIN feature p USING ({STUDENT})",
        "kind = 'call' AND name IN ('rect', 'ellipse', 'line', 'arc', 'point', 'regularPolygon', 'shape')",
        "'Code contains ' || counted_shapes || ' different shapes'"),
    "k4_total_objects": ("total_objects", _OBJ_FROM, "true", _n(_ALL, "total element")),
    "k5_sprites_and_others": ("sprites_and_others", _OBJ_FROM, "true",
        f"CASE type WHEN 'sprite' THEN {_n('sprites', 'sprite')} ELSE {_n(_OTHERS, 'non-sprite element')} END"),
    "k6_sprites": ("sprites", _OBJ_FROM, "type = 'sprite'", _n("sprites", "sprite")),
    "k7_random_movement": ("random_movement", f"moves x JOIN feature p USING ({STUDENT})", "movement = 'random'",
        _n("p.random", "instance", " of movement using the randomNumber() function")),
    "k7_counter_movement": ("counter_movement", f"moves x JOIN feature p USING ({STUDENT})", "movement = 'counter'",
        _n("p.counter", "instance", " of movement using the counter pattern")),
    "k8_property_changes": ("property_changes", "changes x", "true",
        f"CASE WHEN method IS NULL THEN object || ' object''s ' || property || ' property updated ' || {_CHANGE_WHERE} ELSE object || ' object updated by its ' || method || ' method ' || {_CHANGE_WHERE} END"),
    "k9_animation": ("animation", f"changes x JOIN (SELECT {STUDENT}, identifier AS object FROM sprite) s USING ({STUDENT}, object)",
        "NOT in_draw AND method = 'setAnimation'", "object || ' sprite''s animation is properly set'"),
    "k10_velocity": ("velocity", f"changes x JOIN (SELECT {STUDENT}, identifier AS object FROM sprite) s USING ({STUDENT}, object)",
        "NOT in_draw AND contains(property, 'velocity')", "object || ' object''s velocity updated outside of the draw loop'"),
    "k11_user_conditionals": ("user_conditionals", "facts x", "kind = 'if' AND in_draw AND trigger = 'user'", "'conditional triggered by user interaction'"),
    "k12_variable_conditionals": ("variable_conditionals", "facts x", "kind = 'if' AND in_draw AND trigger = 'variable'", "'conditional triggered by variable value'"),
    "k13_object_conditionals": ("object_conditionals", "facts x", "kind = 'if' AND in_draw AND trigger = 'object'", "'conditional triggered by object property value'"),
    "k14_function_definitions": ("function_definitions", "defs x", "true", "'definition of ' || function || ' function'"),
    "k15_function_calls": ("function_calls", f"facts x JOIN (SELECT DISTINCT {STUDENT}, function AS name FROM defs) d USING ({STUDENT}, name)",
        "kind = 'call'", "'call to ' || name || ' function'"),
}


def _line_text(message: str) -> str:
    return f"CASE WHEN x.start = x.end_line THEN 'Line ' || x.start ELSE 'Lines ' || x.start || '-' || x.end_line END || ': ' || {message}"


CTES["items"] = " UNION ALL ".join(
    f"SELECT {STUDENT}, '{section}' AS section, x.seq, {_line_text(message)} AS text FROM {source} WHERE {where}"
    for section, source, where, message in _EVIDENCE_SQL.values()
)


def _items(i: Inputs, *sections: str):
    facts = i.facts()
    if not sections or rules.looks_up(sections):
        facts = materialize(facts.drop("op", "args", "value"), "facts")
    stats = features.name_stats(facts)
    return rules.evidence_items(facts, stats, features.program_features(stats), sections=list(sections) or None)


def _evidence_query(name: str, section: str) -> None:
    @query(name, f"SELECT {STUDENT}, seq, text FROM items WHERE section = '{section}'")
    def _(i):
        return _items(i, section).select(*STUDENT_KEY, "seq", "text")


for _name, (_section, *_rest) in _EVIDENCE_SQL.items():
    _evidence_query(_name, _section)


@query("k1_evidence_lines", f"SELECT {STUDENT}, section, count(DISTINCT text) AS n_texts FROM items GROUP BY {STUDENT}, section")
def _(i):
    return _items(i).select(*STUDENT_KEY, "section", "text").distinct().groupBy(*STUDENT_KEY, "section").agg(
        F.count(F.lit(1)).alias("n_texts")
    )


_SECTIONS = ", ".join(
    f"('{r.key_concept}', '{r.lesson}', '{s}', {n})" for r in rules.RULES.values() for n, s in enumerate(r.evidence)
)
CTES["rule_section"] = f"SELECT * FROM (VALUES {_SECTIONS}) AS t(key_concept, tree_lesson, section, place)"
CTES["evidence_list"] = f"""SELECT {STUDENT}, key_concept, string_agg(text, ' ' ORDER BY place, seq) AS evidence FROM
  (SELECT {STUDENT}, key_concept, text, arg_min(place, place * 100000 + seq) AS place, arg_min(seq, place * 100000 + seq) AS seq
   FROM items JOIN rule_section ON rule_section.section = items.section AND tree_lesson = lesson GROUP BY {STUDENT}, key_concept, text)
  GROUP BY {STUDENT}, key_concept"""


@query("f4_evidence_lists", f"SELECT {STUDENT}, key_concept, evidence FROM evidence_list")
def _(i):
    facts = materialize(i.facts(), "facts")
    stats, requested = features.name_stats(facts), i.requested()
    items = rules.evidence_items(facts, stats, features.program_features(stats), requested=requested)
    lists = rules.evidence_lists(rules.rule_evidence(items, requested))
    return lists.select(*STUDENT_KEY, "key_concept", F.array_join("evidence", " ").alias("evidence"))


CTES["rule_result"] = f"""SELECT {STUDENT}, key_concept, '' AS observations, coalesce(evidence, '') AS evidence, label,
  CASE WHEN label = '' THEN '' ELSE key_concept || ' / ' || label END AS reason
  FROM ruled LEFT JOIN evidence_list USING ({STUDENT}, key_concept) WHERE tree_lesson = lesson"""


@query("j11_rule_rows", f"SELECT {STUDENT}, key_concept, observations, evidence, label, reason FROM rule_result")
def _(i):
    facts = materialize(scan.facts(i.programs()).drop("op", "args", "value"), "facts")
    rows = rules.rule_rows(i.programs(), facts, i.requested(), i.rubric_levels())
    return rows.withColumn("evidence", F.array_join("evidence", " "))


# A program of bodies without braces, behind sid % 5 empty lines.
_BARE = """function draw() {
  if (keyDown("up")) s.x = s.x + 1;
  else turn();
  while (v < 3) v = v + 1;
  if (a)
    if (b > 2) one();
    else two();
  for (var i = 0; i < 3; i++) { if (c) s.y = 4; }
}
if (d == 1)
  last(5)
"""
_BARE_FACTS = [
    ("function", 1, 9, False), ("if", 2, 3, True), ("assign", 2, 2, True), ("call", 3, 3, True), ("assign", 4, 4, True),
    ("if", 5, 7, True), ("if", 6, 7, True), ("call", 6, 6, True), ("call", 7, 7, True), ("declare", 8, 8, True), ("if", 8, 8, True),
    ("assign", 8, 8, True), ("if", 10, 11, False), ("call", 11, 11, False),
]


@query(
    "i1_bodies_without_braces",
    f"""SELECT {STUDENT}, kind, CAST(s + sid % 5 AS INT) AS "start", CAST(e + sid % 5 AS INT) AS "end", in_draw
    FROM student, (VALUES {", ".join(f"('{k}', {a}, {b}, {d})" for k, a, b, d in _BARE_FACTS)}) AS f(kind, s, e, in_draw)""",
)
def _(i):
    gap = F.repeat(F.lit("\n"), (F.col("sid") % 5).cast("int"))
    bare = i.programs().select(*STUDENT_KEY, F.concat(gap, F.lit(_BARE)).alias("code"))
    return scan.facts(bare).select(*STUDENT_KEY, "kind", "start", "end", "in_draw")
