"""Statement scan, features, rules and evidence on whole programs."""

import pytest
from pyspark.sql import functions as F

from tallymark.catalog import QUERIES, Inputs
from tallymark.operators import facts as scan
from tallymark.operators import features, rules

SCHEMA = "dataset string, experiment string, lesson string, student_id string, code string"

POND = """background("green");
var weather = "rain";
var frog = createSprite(200, 300);
frog.setAnimation("frog");
var lily = createSprite(120, 80);
var lily2 = createSprite(260, 80);
lily.setAnimation("leaf");
lily.velocityX = 1;
function splash() {
  fill("white");
}
function draw() {
  if (weather === "rain") {
    splash();
    background("grey");
  }
  drops = randomNumber(2, 9);
  frog.y = frog.y - 3;
  if (drops > 5) {
    lily.visible = false;
  }
  if (frog.x == lily.x) {
    frog.setAnimation("jump");
  }
  drawSprites();
}
"""

BRANCHES = """if (!true) {
  var a = 5;
  if (a < 4) {
    a++;
  }
} else {
  if (p.speed) {
    helper(a);
  }
  if (a) { a = 6; }
  if (5) {
    var b = 7
  }
}"""


def program(spark, code):
    return spark.createDataFrame([("d", "e", "l", "s", code)], SCHEMA)


def scanned(spark, code):
    return scan.facts(program(spark, code))


def test_tables_of_a_program(spark):
    facts = scanned(spark, POND).cache()
    lines = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert [(r.draw_start, r.draw_end) for r in features.draw_ranges(facts).collect()] == [(12, 26)]
    conditionals = sorted(features.conditionals(facts).collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.trigger, r.in_draw) for r in conditionals] == [
        (13, 16, "variable", True),
        (19, 21, "variable", True),
        (22, 24, "object", True),
    ]
    assert [(r.movement, r.start, r.end) for r in features.movements(facts).collect()] == [("counter", 18, 18)]
    changes = sorted(features.property_changes(facts).collect(), key=lambda r: r.start)
    assert [(r.start, r.in_draw) for r in changes] == [(4, False), (7, False), (8, False), (18, True), (20, True), (23, True)]
    objects = sorted(features.objects(facts).collect(), key=lambda r: r.start)
    assert [(r.start, r.type, r.identifier) for r in objects] == [
        (1, "background", ""), (3, "sprite", "frog"), (5, "sprite", "lily"), (6, "sprite", "lily2"), (15, "background", ""),
    ]
    assert [(r.identifier, r.value) for r in features.variables(facts).collect()] == [("weather", '"rain"')]
    functions = features.user_functions(facts).collect()
    assert [(r.function, r.start, r.end, r.calls) for r in functions] == [("splash", 9, 11, 1)]
    assert features.function_calls(facts).count() == 8
    assert lines(facts.where("kind = 'unparsed'")) == []


def test_nested_conditionals(spark):
    found = sorted(features.conditionals(scanned(spark, BRANCHES)).collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.trigger) for r in found] == [
        (1, 14, "untracked"), (3, 5, "variable"), (7, 9, "object"), (10, 10, "variable"), (11, 13, "untracked")
    ]


def test_statements_of_conditionals(spark):
    code = "function draw() {\n if (a) {\n  b();\n  if (c) { d = 1; }\n } else {\n  e++;\n }\n f();\n}\nif (g) { h(); }"
    rows = features.conditional_statements(scanned(spark, code)).collect()
    assert sorted((r.kind, r.start, r.if_start) for r in rows) == [
        ("assign", 4, 2), ("assign", 4, 4), ("call", 3, 2), ("update", 6, 2)
    ]


def test_brackets_of_any_depth(spark):
    deep = "(" * 40 + "1" + ")" * 40
    code = (
        f"f{deep};\nfunction draw() {{\n s.x = randomNumber({deep}, 2);\n if (g({deep}) > 1) {{ t(); }}\n}}\n"
        f"var s = createSprite(h({deep}, (2)), 3);\n((((\n)open(;\nlast();"
    )
    rows = sorted(scanned(spark, code).collect(), key=lambda r: r.seq)
    assert [(r.kind, r.name or r.property, r.call, r.random, r.trigger) for r in rows] == [
        ("call", "f", None, None, None), ("function", "draw", None, None, None), ("assign", "x", "randomNumber", True, None),
        ("if", None, None, None, "user"), ("call", "t", None, None, None), ("declare", "s", "createSprite", None, None),
        ("unparsed", None, None, None, None), ("call", "last", None, None, None),
    ]
    assert rows[0].args == deep[1:-1] and rows[2].args == f"{deep}, 2" and rows[5].args == f"h({deep}, (2)), 3"


def test_many_and_bare_declarators(spark):
    names = [f"v{n}" for n in range(150)]
    code = "var " + ", ".join(f"{n} = {i}" for i, n in enumerate(names)) + ";\nafter();\nvar x = foo(a, b = 2), y, z = [1, w, 2], q;"
    rows = sorted(scanned(spark, code).collect(), key=lambda r: r.seq)
    assert len({r.seq for r in rows}) == len(rows)
    assert [r.name for r in rows] == [*names, "after", "x", "y", "z", "q"]
    assert [r.value for r in rows[151:]] == ["foo(a, b = 2)", None, "[1, w, 2]", None]


def test_declarations_in_heads(spark):
    code = "for (var i = f(1, 2), n = 3; i < n; i++) {\n  g(i);\n}\nvar run = function (a) {\n  h();\n};\nfor (const k of all) { }"
    rows = sorted(scanned(spark, code).where("kind = 'declare'").collect(), key=lambda r: r.seq)
    assert [(r.name, r.value, r.start) for r in rows] == [("i", "f(1, 2)", 1), ("n", "3", 1), ("run", None, 4), ("k", None, 7)]


TRIGGERS = {
    'keyDown("up")': "user",
    "anything(1)": "user",
    "s.isTouching(t)": "user",
    "x > 3": "variable",
    "3 > x": "variable",
    "s.x == x": "variable",
    "s.x > 3": "object",
    "s.x > foo(1)": "object",
    "foo(1) > 3": "user",
    "x": "variable",
    "s.visible": "object",
    "true": "untracked",
    "1 > 2": "untracked",
    "a && b": "untracked",
    "!x": "untracked",
    "x < -1": "variable",
}


def many(spark, codes):
    return spark.createDataFrame([("d", "e", "l", str(n), code) for n, code in enumerate(codes)], SCHEMA)


def test_triggers(spark):
    found = features.conditionals(scan.facts(many(spark, [f"if ({t}) {{ y(); }}" for t in TRIGGERS]))).collect()
    got = {int(r.student_id): r.trigger for r in found}
    assert [got[n] for n in range(len(TRIGGERS))] == list(TRIGGERS.values())


MOVEMENT = {
    "s.x = s.x + 1;": ["counter"],
    "s.x = 1 - s.x;": ["counter"],
    "s.x = s.x * 2;": [],
    "s.x += 2;": [],
    "s.x++;": ["counter"],
    "--s.rotation;": ["counter"],
    "s.width++;": [],
    "t.x++;": [],
    "s.y = randomNumber(1, 5);": ["random"],
    "s.y = s.y + randomNumber(1, 5);": ["counter", "random"],
    "if (a) { if (b) { s.x++; } else { s.y++; } }": ["counter", "counter"],
    "if (a) { b(); } else if (c) { s.x++; } else { s.y++; }": [],
    "for (var i = 0; i < 3; i++) { s.x++; }": [],
    "switch (a) {\ncase 1:\n s.x++;\n}": [],
}


def test_movement(spark):
    codes = [
        f"var s = createSprite(1, 2);\nfunction draw() {{\n{m}\n}}\nvar t = createSprite(1, 2);" for m in MOVEMENT
    ]
    got = {n: [] for n in range(len(MOVEMENT))}
    for r in features.movements(scan.facts(many(spark, codes))).collect():
        got[int(r.student_id)].append(r.movement)
    assert [sorted(kinds) for kinds in got.values()] == list(MOVEMENT.values())


def test_statements_over_several_lines(spark):
    code = (
        "var s = createSprite(1,\n  2), t = 5; // {\nbackground(rgb(\n  randomNumber(0,255), \"a{b;(\" ,3\n));\n"
        "function draw()\n{\n  x = 1 +\n    2;\n}\nfoo(1;\nvar u = 3;\n"
    )
    rows = sorted(scanned(spark, code).collect(), key=lambda r: r.seq)
    assert [(r.kind, r.name, r.start, r.end) for r in rows] == [
        ("declare", "s", 1, 2), ("declare", "t", 1, 2), ("call", "background", 3, 5),
        ("function", "draw", 6, 10), ("assign", "x", 8, 9), ("unparsed", None, 11, 11), ("declare", "u", 12, 12),
    ]


def test_repeated_definitions(spark):
    code = "f();\nfunction f() { g(); }\nf();\nfunction f() { h(); }\nf();"
    rows = sorted(features.user_functions(scanned(spark, code)).collect(), key=lambda r: r.start)
    assert [(r.start, r.calls) for r in rows] == [(2, 3), (4, 2)]


def test_named_arguments(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("rect", "1, a, b + 1, foo(2, 3), 4, 5"), ("text", '"a, b", x')], "f string, a string")
    got = df.select(scan.named_args(F.col("f"), F.col("a")).alias("n")).collect()
    assert [(n.name, n.value) for n in got[0].n] == [("x", "1"), ("y", "a"), ("w", "foo(2, 3)"), ("h", "4")]
    assert [(n.name, n.value) for n in got[1].n] == [("str", '"a, b"'), ("x", "x")]


def ruled(spark, code, concept, lesson):
    programs = program(spark, code)
    requested = spark.createDataFrame(
        [("d", "e", "l", lesson, concept)],
        "dataset string, experiment string, lesson string, tree_lesson string, key_concept string",
    )
    levels = spark.createDataFrame(
        [], "dataset string, experiment string, lesson string, key_concept string, label string, descriptor string"
    )
    (row,) = rules.rule_rows(programs, scan.facts(programs), requested, levels).collect()
    return row.label, row.evidence


def test_rules_on_a_program(spark):
    label, evidence = ruled(spark, POND, "Modularity - Multiple Sprites", "csd3-2023-L21")
    assert label == "Convincing Evidence"  # two of the three sprites are animated
    assert evidence == [
        "Line 3: Code contains 3 sprites",
        "Line 5: Code contains 3 sprites",
        "Line 6: Code contains 3 sprites",
        "Line 4: frog sprite's animation is properly set",
        "Line 7: lily sprite's animation is properly set",
        "Line 8: lily object's velocity updated outside of the draw loop",
    ]
    label, evidence = ruled(spark, POND, "Modularity - Use of Functions", "csd3-2023-L28")
    assert (label, evidence) == (
        "Limited Evidence", ["Lines 9-11: definition of splash function", "Line 14: call to splash function"]
    )
    label, evidence = ruled(spark, POND, "Algorithms and Control - Conditionals", "csd3-2023-L18")
    assert evidence[-1] == "Lines 22-24: conditional triggered by object property value"


def test_rules_without_statements(spark):
    assert ruled(spark, "// nothing", "Position - Shapes", "csd3-2023-L7") == ("No Evidence", [])
    assert ruled(spark, "// nothing", "Modularity - Multiple Sprites", "csd3-2023-L18") == ("Limited Evidence", [])
    assert ruled(spark, "rect();", "Unknown", "csd3-2023-L18") == ("", [])


def test_object_evidence(spark):
    code = 'background("black");\nvar a = createSprite(1, 2);\ntext("hi", 1, 2);\nrect(1, 2, 3, 4);\nellipse(1, 2);'
    label, evidence = ruled(spark, code, "Position - Elements and the Coordinate System", "csd3-2023-L11")
    assert label == "Limited Evidence"
    assert evidence == [
        "Line 2: Code contains 1 sprite", "Line 3: Code contains 1 line of text",
        "Line 4: Code contains 2 shapes", "Line 5: Code contains 2 shapes",
    ]
    label, evidence = ruled(spark, code, "Position and Movement", "csd3-2023-L18")
    assert evidence[0] == "Line 1: Code contains 3 non-sprite elements"


def test_rules_can_be_added(spark):
    from pyspark.sql import functions as F

    rules.register("Own", "own-lesson", lambda: F.when(F.col("texts") > 0, "Yes").otherwise("No"), "total_objects")
    try:
        assert ruled(spark, 'text("a", 1, 2);', "Own", "own-lesson") == ("Yes", ["Line 1: Code contains 1 total element"])
        with pytest.raises(ValueError):
            rules.register("Own", "own-lesson", lambda: F.lit("x"), "no such section")
    finally:
        del rules.RULES[("Own", "own-lesson")]


BARE_AND_BRACED = [
    ('if (a) x();', 'if (a) {x();}'),
    ('if (a) x(); else y();', 'if (a) {x();} else {y();}'),
    ('if (a)\n  x();\nelse\n  y();\nz();', 'if (a) {\n  x();} else\n  {y();}\nz();'),
    ('if (a) if (b) x(); else y();\nz();', 'if (a) {if (b) {x();} else {y();}}\nz();'),
    ('if (a) while (b) x(); else y();', 'if (a) {while (b) {x();}} else {y();}'),
    ('if (a) {\n  if (b) s.x = 1\n}\nu();', 'if (a) {\n  if (b) {s.x = 1}\n}\nu();'),
    ('if (a) for (var i = 0; i < 3; i++) { x(); }\nelse if (b) y();\nelse z();', 'if (a) {for (var i = 0; i < 3; i++) { x(); }}\nelse if (b) {y();}\nelse {z();}'),
    ('if (a) s.x = s.x + 1 }', 'if (a) {s.x = s.x + 1} }'),
    ('do { x(); } while (a);\ny();', 'do { x(); } while (a);\ny();'),
    ('var t = "if (a) x(); else y();";\nz();', 'var t = "if (a) x(); else y();";\nz();'),
]


def test_bodies_with_and_without_braces(spark):
    rows = []
    for n, pair in enumerate(BARE_AND_BRACED):
        for side, body in zip(("bare", "braced"), pair):
            rows.append(("d", side, "l", f"s{n}", f"function draw() {{\n{body}\n}}\nfunction last() {{\n{body}\n}}"))
    programs = spark.createDataFrame(rows, "dataset string, experiment string, lesson string, student_id string, code string")
    found = {}
    for row in scan.facts(programs).orderBy("seq").collect():
        kept = {k: v for k, v in row.asDict().items() if k not in ("seq", "done", "experiment")}
        found.setdefault((row["student_id"], row["experiment"]), []).append(tuple(kept.values()))
    for n, pair in enumerate(BARE_AND_BRACED):
        if "do {" in pair[0] or n == 2:  # a brace of its own line changes where a block starts
            continue
        assert found[f"s{n}", "bare"] == found[f"s{n}", "braced"], pair
    lines = [r[3:6] for r in found["s2", "bare"] if r[3] == "if"]
    assert [(r[1], r[2]) for r in lines][0] == (2, 5)


def _kept(spark, code):
    programs = spark.createDataFrame([("d", "e", "l", "s", code)], "dataset string, experiment string, lesson string, student_id string, code string")
    found = scan.facts(programs).orderBy("seq").collect()
    return [(r["kind"], r["name"] or r["value"], r["start"], r["end"], r["in_draw"]) for r in found]


def test_a_lost_brace_spoils_one_island(spark):
    code = "function a() {\n  if (x) {\n    u();\n\nfunction draw() {\n  s.x = 1;\n}\nfunction b() {\n  v();\n}\n"
    assert _kept(spark, code) == [
        ("function", "a", 1, 3, False), ("if", "x", 2, 3, False), ("call", "u", 3, 3, False),
        ("function", "draw", 5, 7, False), ("assign", "1", 6, 6, True),
        ("function", "b", 8, 10, False), ("call", "v", 9, 9, False),
    ]
    # The last island ends with the program.
    assert _kept(spark, "u();\nfunction draw() {\n  v();\n")[1:] == [("function", "draw", 2, 3, False), ("call", "v", 3, 3, True)]


def test_balanced_programs_have_no_restart(spark):
    nested = "function draw() {\nfunction b() {\nv();\n}\ns.x = 1;\n}"
    assert _kept(spark, nested)[0] == ("function", "draw", 1, 6, False)
    assert _kept(spark, nested)[-1] == ("assign", "1", 5, 5, True)
    # A function in a string or comment is no restart; too many closing braces change nothing.
    assert _kept(spark, "}\nfunction draw() {\n  v();\n}\nu();")[1:] == [("call", "v", 3, 3, True), ("call", "u", 5, 5, False)]


@pytest.mark.parametrize("open_ended", ["/* no end", "`no end", "/* `no end", "` /* no end", "var t = `a${1} {"])
def test_quotes_without_end_spoil_their_line(spark, open_ended):
    code = f"u();\n{open_ended}\nfunction draw() {{\n  s.x = 1; // it's\n}}\nv(\"'\", 1);\n"
    kept = [r for r in _kept(spark, code) if r[2] != 2]
    assert kept[0] == ("call", "u", 1, 1, False)
    assert kept[1:3] == [("function", "draw", 3, 5, False), ("assign", "1", 4, 4, True)]
    whole = "u();\n/* a\n{ */\nvar t = `b\n{`;\nv();"
    assert [r[:4] for r in _kept(spark, whole)] == [("call", "u", 1, 1), ("declare", "t", 4, 5), ("call", "v", 6, 6)]


def test_empty_programs_have_no_facts(spark):
    assert _kept(spark, "") == [] and _kept(spark, " \n") == []


def test_sections_alone_give_the_rows_of_all(spark):
    facts = scanned(spark, POND)
    # A fact without a program's key or a name is in no section.
    for column in ("student_id", "trigger"):
        facts = facts.unionByName(facts.limit(30).withColumn(column, F.lit(None).cast("string")))
    facts = facts.localCheckpoint()
    stats = features.name_stats(facts).localCheckpoint()
    counts = features.program_features(stats).localCheckpoint()
    rows = lambda df: sorted(tuple(r) for r in df.collect() if r.section in alone)
    for alone in (["variable_conditionals", "function_definitions"], ["different_shapes"], ["velocity"], ["total_objects"]):
        assert rows(rules.evidence_items(facts, stats, counts, sections=alone)) == rows(rules.evidence_items(facts, stats, counts)), alone


def test_conditionals_read_the_facts_once(spark, tmp_path):
    spark.sql("SELECT id AS event_id, id % 7 AS user_id, 'click' AS event_type, '{}' AS props FROM range(48)").write.parquet(f"{tmp_path}/events.parquet")
    plan = QUERIES["k11_user_conditionals"](Inputs(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2  # the facts and their draw functions
    # No branch per statement and column, which would be too long a method to be compiled.
    assert plan.count("CASE WHEN") < 30
