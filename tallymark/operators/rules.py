"""Rule labels: one registered rule per (key concept, lesson).

A rule is a label expression over the feature columns and an ordered list of
evidence sections. Register more with ``register``; rules are data, so all of
them are evaluated in one pass over the programs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import (
    COUNTED_SHAPES,
    RUN_KEY,
    STUDENT_KEY,
    VALID_LABELS,
)
from tallymark.operators.features import (
    FEATURES,
    MOVEMENT_PROPERTIES,
    drawn_type,
    is_change,
    kind_is,
    with_figures,
    with_name_key,
)

EXTENSIVE, CONVINCING, LIMITED, NONE = VALID_LABELS


@dataclass(frozen=True)
class Rule:
    key_concept: str
    lesson: str
    label: Callable[[], Column]
    evidence: tuple[str, ...]


RULES: dict[tuple[str, str], Rule] = {}


def register(key_concept: str, lesson: str, label: Callable[[], Column], *evidence: str) -> None:
    """Add or replace the rule of one concept in one lesson."""
    unknown = set(evidence) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown evidence sections: {sorted(unknown)}")
    RULES[(key_concept, lesson)] = Rule(key_concept, lesson, label, evidence)


# ---- evidence sections ------------------------------------------------------
# The wording of all messages, and the thresholds and concept names
# of the rules below.


def _counted(n: Column, noun: str, tail: str = "") -> Column:
    return F.concat(
        F.lit("Code contains "), n.cast("string"), F.lit(f" {noun}"), F.when(n > 1, "s").otherwise(""), F.lit(tail)
    )


def _total() -> Column:
    return F.col("sprites") + F.col("shapes") + F.col("texts")


def _by_type(**texts: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, value in texts.items():
        text = F.when(F.col("object_type") == name, value).otherwise(text)
    return text


def _sprite_text() -> Column:
    return _counted(F.col("sprites"), "sprite")


def _object_types() -> Column:
    return _by_type(
        shape=_counted(F.col("shapes"), "shape"),
        sprite=_sprite_text(),
        text=_counted(F.col("texts"), "line", " of text"),
    )


def _different_shapes() -> Column:
    text = F.concat(F.lit("Code contains "), F.col("counted_shapes").cast("string"), F.lit(" different shapes"))
    return F.when(kind_is("call") & F.col("name").isin(COUNTED_SHAPES), text)


def _total_objects() -> Column:
    return F.when(F.col("object_type").isNotNull(), _counted(_total(), "total element"))


def _sprites_and_others() -> Column:
    others = _counted(F.col("shapes") + F.col("texts"), "non-sprite element")
    return F.when(F.col("object_type") == "sprite", _sprite_text()).when(F.col("object_type").isNotNull(), others)


def _movement(kind: str, how: str) -> Column:
    n = F.col("n_random" if kind == "random" else "n_counter")
    text = F.concat(
        F.lit("Code contains "), n.cast("string"), F.lit(" instance"), F.when(n > 1, "s").otherwise(""),
        F.lit(f" of movement using the {how}"),
    )
    return F.when(F.col("is_move") & F.col(kind), text)


def _property_changes() -> Column:
    where = F.when(F.col("in_draw"), " in the draw loop").otherwise(" outside of the draw loop")
    prop = F.concat(F.col("object"), F.lit(" object's "), F.col("property"), F.lit(" property updated"), where)
    method = F.concat(F.col("object"), F.lit(" object updated by its "), F.col("name"), F.lit(" method"), where)
    return F.when(is_change(), F.when(kind_is("method"), method).otherwise(prop))


def _sprite_change(condition: Column, text: str) -> Column:
    hit = is_change() & (F.col("type") == "sprite") & ~F.col("in_draw") & condition
    return F.when(hit, F.concat(F.col("object"), F.lit(text)))


def _animation() -> Column:
    return _sprite_change(
        kind_is("method") & (F.col("name") == "setAnimation"), " sprite's animation is properly set"
    )


def _velocity() -> Column:
    return _sprite_change(
        F.col("property").contains("velocity"), " object's velocity updated outside of the draw loop"
    )


def _conditional(trigger: str, what: str) -> Column:
    hit = kind_is("if") & F.col("in_draw") & (F.col("trigger") == trigger)
    return F.when(hit, F.lit(f"conditional triggered by {what}"))


def _function_definitions() -> Column:
    own = kind_is("function") & (F.col("name") != "draw") & ~F.coalesce(F.col("seen_draw"), F.lit(False))
    return F.when(own, F.concat(F.lit("definition of "), F.col("name"), F.lit(" function")))


def _function_calls() -> Column:
    known = kind_is("call") & (F.col("n_open_defs") > 0)
    return F.when(known, F.concat(F.lit("call to "), F.col("name"), F.lit(" function")))


# Section name -> message of one fact, NULL where the fact is no evidence.
SECTIONS: dict[str, Callable[[], Column]] = {
    "object_types": _object_types,
    "different_shapes": _different_shapes,
    "total_objects": _total_objects,
    "sprites_and_others": _sprites_and_others,
    "sprites": lambda: _by_type(sprite=_sprite_text()),
    "random_movement": lambda: _movement("random", "randomNumber() function"),
    "counter_movement": lambda: _movement("counter", "counter pattern"),
    "property_changes": _property_changes,
    "animation": _animation,
    "velocity": _velocity,
    "user_conditionals": lambda: _conditional("user", "user interaction"),
    "variable_conditionals": lambda: _conditional("variable", "variable value"),
    "object_conditionals": lambda: _conditional("object", "object property value"),
    "function_definitions": _function_definitions,
    "function_calls": _function_calls,
}
_BITS = {section: 1 << n for n, section in enumerate(SECTIONS)}
_MOVEMENT_SECTIONS = ("random_movement", "counter_movement")
# Sections that show what is known of a name (``name_stats``) or counted in a program.
_OF_OBJECTS = ("object_types", "total_objects", "sprites_and_others", "sprites", *_MOVEMENT_SECTIONS)
_OF_NAMES = (*_OF_OBJECTS, "animation", "velocity", "function_calls")
_OF_COUNTS = (*_OF_OBJECTS, "different_shapes")


# ---- rules ------------------------------------------------------------------


def _grade(*steps: tuple[str, str], otherwise: str = NONE) -> Callable[[], Column]:
    """First condition (SQL over features) that holds gives the label."""

    def label() -> Column:
        result = None
        for condition, name in steps:
            test = F.expr(condition)
            result = F.when(test, name) if result is None else result.when(test, name)
        return result.otherwise(otherwise)

    return label


def _multiple_sprites(most: int, some: int) -> Callable[[], Column]:
    return _grade(
        (f"sprites >= {most} AND sprites_animated >= {most} AND sprites_with_velocity >= 2", EXTENSIVE),
        (f"sprites >= {some} AND sprites_animated >= {some} AND sprites_with_velocity >= 1", CONVINCING),
        ("sprites >= 2 AND sprites_animated >= 2", LIMITED),
    )


# Concept names, lessons and thresholds of the rubric rules.
register(
    "Position - Shapes", "csd3-2023-L7",
    _grade(
        ("counted_shapes >= 4", EXTENSIVE),
        ("counted_shapes >= 3", CONVINCING),
        ("counted_shapes >= 1", LIMITED),
    ),
    "different_shapes",
)
register(
    "Position - Elements and the Coordinate System", "csd3-2023-L11",
    _grade(
        ("shapes >= 2 AND sprites >= 2 AND texts >= 2", EXTENSIVE),
        ("shapes >= 1 AND sprites >= 2 AND texts >= 1", CONVINCING),
        ("shapes + sprites + texts >= 2 AND texts >= 1", LIMITED),
    ),
    "object_types",
)
register(
    "Modularity - Sprites and Sprite Properties", "csd3-2023-L14",
    _grade(
        ("sprites >= 2 AND sprites_updated >= 2", EXTENSIVE),
        ("sprites >= 1 AND sprites_updated >= 1", CONVINCING),
        ("sprites >= 1", LIMITED),
    ),
    "sprites", "property_changes",
)
register(
    "Position and Movement", "csd3-2023-L14",
    _grade(
        ("shapes >= 2 AND sprites >= 2 AND texts >= 2 AND random > 0 AND counter > 0", EXTENSIVE),
        ("shapes >= 1 AND sprites >= 2 AND texts >= 1 AND random + counter > 0", CONVINCING),
        ("shapes + sprites + texts >= 3", LIMITED),
    ),
    "object_types", *_MOVEMENT_SECTIONS,
)
_MIXED = "cond_user > 0 AND cond_variable + cond_object > 0"
register(
    "Algorithms and Control - Conditionals", "csd3-2023-L18",
    _grade(
        (f"cond_draw >= 3 AND {_MIXED}", EXTENSIVE),
        (f"cond_draw >= 2 AND {_MIXED}", CONVINCING),
        ("cond_user + cond_variable + cond_object > 0", LIMITED),
    ),
    "user_conditionals", "variable_conditionals", "object_conditionals",
)
register(
    "Modularity - Multiple Sprites", "csd3-2023-L18",
    _grade(
        ("sprites >= 3 AND sprites_updated >= 3", EXTENSIVE),
        ("sprites >= 1 AND sprites_updated >= 1", CONVINCING),
        otherwise=LIMITED,  # also without any sprite
    ),
    "sprites", "property_changes",
)
register(
    "Position and Movement", "csd3-2023-L18",
    _grade(
        ("sprites >= 3 AND shapes + texts >= 1 AND counter > 0 AND random > 0", EXTENSIVE),
        ("sprites >= 2 AND shapes + texts > 0 AND random + counter > 0", CONVINCING),
        ("shapes + sprites + texts >= 1", LIMITED),
    ),
    "sprites_and_others", *_MOVEMENT_SECTIONS,
)
register(
    "Modularity - Multiple Sprites", "csd3-2023-L21",
    _multiple_sprites(most=3, some=2), "sprites", "animation", "velocity",
)
register(
    "Modularity - Multiple Sprites", "csd3-2023-L24",
    _multiple_sprites(most=4, some=3), "sprites", "animation", "velocity",
)
register(
    "Modularity - Use of Functions", "csd3-2023-L28",
    _grade(
        ("functions >= 3 AND functions_called_again > 0", EXTENSIVE),
        ("functions >= 2 AND functions_called > 0", CONVINCING),
        ("functions >= 1 AND functions_called > 0", LIMITED),
    ),
    "function_definitions", "function_calls",
)


def rule_dim(spark) -> DataFrame:
    """The registered rules' evidence sections: a few dozen constant rows."""
    return spark.createDataFrame(
        [(r.key_concept, r.lesson, s, i) for r in RULES.values() for i, s in enumerate(r.evidence)],
        "key_concept string, tree_lesson string, section string, section_ord int",
    )


def rule_label() -> Column:
    """Label by (key_concept, tree_lesson); '' where no rule is registered."""
    result = F.when(F.lit(False), "")
    for rule in RULES.values():
        here = (F.col("key_concept") == rule.key_concept) & (F.col("tree_lesson") == rule.lesson)
        result = result.when(here, rule.label())
    return result.otherwise("")


# ---- jobs -------------------------------------------------------------------


def label_programs(programs: DataFrame, features: DataFrame, requested: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Rule label of every program for every requested concept of its run.

    ``requested`` has the run key, tree_lesson and key_concept. A program
    without any statement still gets its label.
    """
    zeros = {name: 0 for name in FEATURES}
    asked = programs.select(*keys).join(requested, RUN_KEY)
    return (
        asked.join(features, keys, "left")
        .fillna(zeros)
        .select(*keys, "tree_lesson", "key_concept", rule_label().alias("label"))
    )


def evidence_items(
    facts: DataFrame, stats: DataFrame, features: DataFrame, keys: list[str] = STUDENT_KEY, requested: DataFrame | None = None,
    sections: list[str] | None = None,
) -> DataFrame:
    """Every message a section would give: one row per fact and section.

    With ``requested``, only the sections that the run's rules show are built, with
    ``sections`` only those named; ``stats`` and ``features`` are joined for sections
    that show something of them.
    """
    built = list(SECTIONS) if sections is None else sections
    about = with_name_key(facts).where(F.col("ns").isNotNull())
    by_name, by_count = (any(s in need for s in built) for need in (_OF_NAMES, _OF_COUNTS))
    names = stats.select(
        *keys, "ns", "nm", "type", "moves", "n_open_defs",
        F.col("decl.seq").alias("decl_seq"),
    )
    counts = features.withColumnRenamed("random", "n_random").withColumnRenamed("counter", "n_counter")
    # The facts are the heavy side: they move once, for what is known of names and programs together
    # and for what the run's rules show, which may be a table as long as the programs'.
    shown = None if requested is None else _shown(requested)
    if by_name:
        known = names.join(counts if shown is None else counts.join(shown, RUN_KEY), keys) if by_count else names
        if shown is not None and not by_count:
            known = known.join(shown, RUN_KEY)
        rows = about.join(known, [*keys, "ns", "nm"])
    else:
        named = about.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "nm"]))
        rows = named.join(counts, keys) if by_count else named
        rows = rows if shown is None else rows.join(shown, RUN_KEY)
    if by_name:
        rows = _with_objects(rows)
    found = _messages(built, None if requested is None else _is_shown)
    place, own = [*keys, "seq", "done"], ["e.section", "e.start", "e.end", evidence_text(F.col("e")).alias("text")]
    return rows.select(*place, F.explode(found).alias("e")).select(*place, *own)


def _with_objects(rows: DataFrame) -> DataFrame:
    """Add what a fact draws or declares and whether it moves, from what is known of its name."""
    first = kind_is("declare") & (F.col("seq") == F.col("decl_seq")) & (F.col("type") != "none")
    drawn = F.when(kind_is("call"), drawn_type(F.col("name")))
    is_move = F.col("moves") & F.col("move_start").isNotNull() & F.col("property").isin(MOVEMENT_PROPERTIES)
    return rows.withColumn("object_type", F.when(first, F.col("type")).otherwise(drawn)).withColumn("is_move", is_move)


def _messages(built: Iterable[str], shown: Callable[[str], Column] | None) -> Column:
    """What the sections of ``built`` say of a fact, of all or of those that are ``shown``."""

    def entry_of(section: str) -> Column:
        by_if = section in _MOVEMENT_SECTIONS
        entry = F.struct(
            F.lit(section).alias("section"),
            F.col("move_start" if by_if else "start").alias("start"),
            F.col("move_end" if by_if else "end").alias("end"),
            SECTIONS[section]().alias("message"),
        )
        return entry if shown is None else F.when(shown(section), entry)

    return F.filter(F.array(*[entry_of(s) for s in built]), lambda e: e["message"].isNotNull())


def _shown(requested: DataFrame) -> DataFrame:
    """Per run the sections that its requested rules show, as the bits of a number."""
    dim = F.broadcast(rule_dim(requested.sparkSession))  # a few dozen constant rows
    bits = F.element_at(F.create_map(*[F.lit(x) for pair in _BITS.items() for x in pair]), F.col("section")).cast("bigint")
    return requested.join(dim, ["key_concept", "tree_lesson"]).groupBy(*RUN_KEY).agg(F.bit_or(bits).alias("shown"))


def _is_shown(section: str) -> Column:
    return F.col("shown").bitwiseAND(F.lit(_BITS[section]).cast("bigint")) != 0


def looks_up(sections: Iterable[str]) -> bool:
    """Whether a section needs more than the facts themselves, which are then read several times."""
    return any(s in _OF_NAMES or s in _OF_COUNTS for s in sections)


def evidence_text(e: Column) -> Column:
    """ "Line s: message" or "Lines s-e: message"."""
    start, end = e["start"].cast("string"), e["end"].cast("string")
    return F.when(e["start"] == e["end"], F.concat(F.lit("Line "), start, F.lit(": "), e["message"])).otherwise(
        F.concat(F.lit("Lines "), start, F.lit("-"), end, F.lit(": "), e["message"])
    )


def rule_evidence(items: DataFrame, requested: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Distinct evidence texts per program and concept, with their order."""
    # The rule table is a constant of a few dozen rows.
    sections = F.broadcast(rule_dim(items.sparkSession))
    wanted = requested.join(sections, ["key_concept", "tree_lesson"])
    place = F.struct("section_ord", "done", (-F.col("seq")).alias("inner_first"))
    return (
        items.join(wanted, [*RUN_KEY, "section"])
        .groupBy(*keys, "key_concept", "text")
        .agg(F.min(place).alias("place"))
    )


def evidence_lists(evidence: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """The texts of one program and concept as one ordered array."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return evidence.groupBy(*keys, "key_concept").agg(
        F.transform(ordered, lambda e: e["text"]).alias("evidence")
    )


def concept_lists(items: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """``evidence_lists`` of items by concept: a text has its first place, in one grouping."""
    place = F.struct("section_ord", "done", (-F.col("seq")).alias("inner_first"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), "text")))
    texts = F.array_distinct(F.transform(ordered, lambda e: e["text"]))
    return items.groupBy(*keys, "key_concept").agg(texts.alias("evidence"))


def with_reasons(labels: DataFrame, rubric_levels: DataFrame) -> DataFrame:
    """Labels with the rubric's text for them as ``reason``, '' where it has none."""
    key = [*RUN_KEY, "key_concept", "label"]
    texts = rubric_levels.select(*key, F.col("descriptor").alias("reason"))
    return labels.join(texts, key, "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def program_evidence(facts: DataFrame, requested: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per program: its ``features`` and the ``entries`` of the sections that its run's rules show.

    The facts move once, by program; a run's sections are the bits of a number, which may
    be one of a table as long as the programs'.
    """
    rows = with_figures(facts.join(_shown(requested), RUN_KEY, "left"), keys).withColumns(
        {"decl_seq": F.col("decl.seq"), "n_random": F.col("features.random"), "n_counter": F.col("features.counter")}
        | {name: F.col(f"features.{name}") for name in ("sprites", "shapes", "texts", "counted_shapes")}
    )
    found = _messages(SECTIONS, _is_shown)
    entries = F.transform(
        found,
        lambda e: F.struct(
            e["section"].alias("section"), F.col("done").alias("done"), (-F.col("seq")).alias("inner_first"), evidence_text(e).alias("text")
        ),
    )
    # A fact without a name, as of a call of what is no name, counts but shows nothing.
    entries = F.when(F.col("nm").isNotNull(), entries)
    return _with_objects(rows).groupBy(*keys).agg(
        F.first("features").alias("features"), F.flatten(F.collect_list(entries)).alias("entries")
    )


def rule_rows(programs: DataFrame, facts: DataFrame, requested: DataFrame, rubric_levels: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Result rows of the rules: label, reason from the rubric, evidence list."""
    about = program_evidence(facts, requested, keys).select(*keys, "features.*", "entries")
    asked = programs.select(*keys).join(requested, RUN_KEY)
    zeros = {name: 0 for name in FEATURES}
    # Stored facts are far larger than their files, so no file size may have them broadcast.
    known = asked.join(about.hint("merge"), keys, "left").fillna(zeros).withColumn("label", rule_label())
    rows = known.withColumn("evidence", _listed(rule_sections()))
    return with_reasons(rows, rubric_levels).select(
        *keys,
        "key_concept",
        F.lit("").alias("observations"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        "label",
        "reason",
    )


def rule_sections() -> Column:
    """Evidence sections by (key_concept, tree_lesson), in their order; NULL where no rule is registered."""
    result = F.lit(None).cast("array<string>")
    for rule in RULES.values():
        here = (F.col("key_concept") == rule.key_concept) & (F.col("tree_lesson") == rule.lesson)
        result = F.when(here, F.array(*[F.lit(s) for s in rule.evidence]).cast("array<string>")).otherwise(result)
    return result


def _listed(sections: Column) -> Column:
    """The texts of the entries of ``sections``, each at its first place."""
    places = F.transform(
        F.filter("entries", lambda e: F.array_contains(sections, e["section"])),
        lambda e: F.struct(F.array_position(sections, e["section"]).alias("section_ord"), e["done"], e["inner_first"], e["text"].alias("text")),
    )
    return F.array_distinct(F.transform(F.array_sort(places), lambda e: e["text"]))
