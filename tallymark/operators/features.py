"""Facts -> objects, calls, changes, movement and one feature row per program.

Everything is an aggregate with map-side combination or an equi-join on the
program key, so one program with very many statements is split by name before
its partial results meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.dims import (
    COUNTED_SHAPES,
    MOVEMENT_PROPERTIES,
    SHAPE_FUNCTIONS,
    SPRITE_METHODS,
    STUDENT_KEY,
    USER_INTERACTION_FUNCTIONS,
)

FEATURES = [
    "sprites", "shapes", "texts", "counted_shapes", "sprites_updated", "sprites_animated",
    "sprites_with_velocity", "random", "counter", "cond_draw", "cond_user", "cond_variable",
    "cond_object", "functions", "functions_called", "functions_called_again",
]


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def declared_type(call: Column) -> Column:
    """sprite, text or shape by the function that makes the value, else none."""
    return (
        F.when(call == "createSprite", "sprite")
        .when(call == "text", "text")
        .when(call.isin(SHAPE_FUNCTIONS), "shape")
        .otherwise("none")
    )


def drawn_type(name: Column) -> Column:
    """Type of the nameless object a bare call draws, NULL for other calls."""
    return (
        F.when(name == "background", "background")
        .when(name == "text", "text")
        .when(name.isin(SHAPE_FUNCTIONS), "shape")
    )


def is_change() -> Column:
    """A property set or stepped, or a sprite method called."""
    sets = kind_is("assign", "update") & F.col("object").isNotNull() & F.col("property").isNotNull()
    return sets | (kind_is("method") & F.col("name").isin(SPRITE_METHODS))


def draw_ranges(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """First and last line of the draw function; a later definition replaces it."""
    draw = facts.where(kind_is("function") & (F.col("name") == "draw"))
    return draw.groupBy(*keys).agg(F.max(F.struct("seq", "start", "end")).alias("d")).select(
        *keys, F.col("d.start").alias("draw_start"), F.col("d.end").alias("draw_end")
    )


def mark_draw(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Add in_draw and draw_end to facts that come without them."""
    inside = (F.col("start") >= F.col("draw_start")) & (F.col("end") <= F.col("draw_end"))
    is_draw = kind_is("function") & F.col("name").eqNullSafe(F.lit("draw"))
    joined = facts.drop("in_draw", "draw_end").join(draw_ranges(facts, keys), keys, "left")
    flagged = joined.withColumn("in_draw", F.coalesce(inside, F.lit(False)) & ~is_draw)
    return flagged.withColumn("draw_end", F.when(F.col("in_draw"), F.col("draw_end"))).drop("draw_start")


def mark_movement_lines(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Add move_start and move_end: the outermost if around a statement, or itself.

    Outermost conditionals do not overlap, so the last one begun is the only
    candidate. The statements of one program are ordered once.
    """
    in_order = W.partitionBy(*keys).orderBy("seq")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    here = F.when(kind_is("if") & F.col("in_draw"), F.col("end"))
    outermost = here.isNotNull() & (F.col("start") > F.coalesce(F.max(here).over(earlier), F.lit(-1)))
    begun = (
        facts.withColumn("_outer", outermost | F.max(here).over(earlier).isNull() & here.isNotNull())
        .withColumn("_if", F.max(F.when(F.col("_outer"), F.struct("seq", "start", "end"))).over(in_order))
    )
    covered = (F.col("_if.start") <= F.col("start")) & (F.col("end") <= F.col("_if.end"))
    looked_at = F.col("in_draw") & kind_is("assign", "update")
    return begun.select(
        *[c for c in facts.columns if c not in ("move_start", "move_end")],
        F.when(looked_at, F.when(covered, F.col("_if.start")).otherwise(F.col("start"))).alias("move_start"),
        F.when(looked_at, F.when(covered, F.col("_if.end")).otherwise(F.col("end"))).alias("move_end"),
    )


# ---- tables -----------------------------------------------------------------


def declarations(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """First declaration of every name, with the type of what it holds."""
    first = F.min(F.struct("seq", "call", "start", "end", "args", "value"))
    return (
        facts.where(kind_is("declare"))
        .groupBy(*keys, F.col("name").alias("identifier"))
        .agg(first.alias("d"))
        .select(*keys, "identifier", declared_type(F.col("d.call")).alias("type"), "d.*")
    )


def objects(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Declared sprites, texts and shapes, and what bare calls draw."""
    cols = [*keys, "seq", "identifier", "type", "start", "end", "args"]
    named = declarations(facts, keys).where("type <> 'none'").select(*cols)
    drawn = (
        facts.where(kind_is("call"))
        .withColumn("type", drawn_type(F.col("name")))
        .where(F.col("type").isNotNull())
        .withColumn("identifier", F.lit(""))
    )
    return named.unionByName(drawn.select(*cols))


def variables(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Declared names that hold no drawn object."""
    return declarations(facts, keys).where("type = 'none'").select(
        *keys, "seq", "identifier", "value", "start", "end"
    )


def function_calls(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Statement-level calls, flagged when they read user input."""
    method = F.when(kind_is("method"), F.col("name"))
    return facts.where(kind_is("call", "method")).select(
        *keys, "seq",
        F.when(kind_is("call"), F.col("name")).alias("function"),
        "object", method.alias("method"), "args",
        (kind_is("call") & F.col("name").isin(USER_INTERACTION_FUNCTIONS)).alias("user_interaction"),
        "start", "end",
    )


def user_functions(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Function definitions except draw, with how often each is called.

    The first definition of a name gets all calls. A repeated definition gets
    the calls completed before it; only repeated names are ordered for that.
    """
    names = facts.where(
        kind_is("call") | (kind_is("function") & (F.col("name") != "draw"))
    ).select(*keys, "name", "kind", "seq", "done", "start", "end", "seen_draw")
    per_name = (
        names.groupBy(*keys, "name")
        .agg(
            F.count_if(kind_is("call")).alias("calls"),
            F.count_if(kind_is("function")).alias("n_defs"),
            F.min(F.when(kind_is("function"), F.struct("done", "seq", "start", "end", "seen_draw"))).alias("f"),
        )
        .where("n_defs > 0")
    )
    shown = [*keys, F.col("name").alias("function")]
    first = per_name.select(*shown, "f.seq", "f.start", "f.end", "f.seen_draw", "calls")
    so_far = W.partitionBy(*keys, "name").orderBy("done")
    repeated = (
        names.join(per_name.where("n_defs > 1").select(*keys, "name", F.col("f.seq").alias("first_seq")), [*keys, "name"])
        .withColumn("calls", F.count_if(kind_is("call")).over(so_far))
        .where(kind_is("function") & (F.col("seq") != F.col("first_seq")))
        .select(*shown, "seq", "start", "end", "seen_draw", "calls")
    )
    return first.unionByName(repeated)


def property_changes(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    return facts.where(is_change()).select(
        *keys, "seq", "object", "property",
        F.when(kind_is("method"), F.col("name")).alias("method"),
        "start", "end", "in_draw",
    )


def conditionals(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    return facts.where(kind_is("if")).select(
        *keys, "seq", "done", F.col("value").alias("test"), "trigger", "start", "end", "in_draw"
    )


def conditional_statements(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Statements of all paths of the draw loop's conditionals, once per conditional around them."""
    around = facts.where(kind_is("if") & F.col("in_draw")).select(
        *keys, F.col("seq").alias("if_seq"), F.col("start").alias("if_start"), F.col("end").alias("if_end")
    )
    inside = (F.col("start") >= F.col("if_start")) & (F.col("end") <= F.col("if_end"))
    found = facts.where(~kind_is("if")).join(around, keys).where(inside)
    return found.select(*keys, "seq", "kind", "start", "end", "if_seq", "if_start", "if_end")


def _moves() -> Column:
    return F.col("move_start").isNotNull() & F.col("property").isin(MOVEMENT_PROPERTIES)


def movements(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per (statement, kind of movement) in the draw loop.

    The object must be declared before the draw function ends.
    """
    known = declarations(facts, keys).where("type <> 'none'").select(
        *keys, F.col("identifier").alias("object"), F.col("end").alias("declared")
    )
    kinds = F.array_compact(
        F.array(F.when(F.col("random"), F.lit("random")), F.when(F.col("counter"), F.lit("counter")))
    )
    return (
        facts.where(_moves() & (F.col("random") | F.col("counter")))
        .join(known, [*keys, "object"])
        .where(F.col("declared") <= F.col("draw_end"))
        .select(
            *keys, "seq", F.explode(kinds).alias("movement"), "object", "property",
            F.col("move_start").alias("start"), F.col("move_end").alias("end"),
        )
    )


# ---- one row per program ----------------------------------------------------


def with_name_key(facts: DataFrame) -> DataFrame:
    """Add what a fact is about: an object name, a function name or a trigger."""
    own_function = kind_is("function") & (F.col("name") != "draw")
    ns = (
        F.when(kind_is("declare") | is_change(), "object")
        .when(kind_is("call") | own_function, "function")
        .when(kind_is("if"), "trigger")
    )
    nm = (
        F.when(kind_is("declare", "call", "function"), F.col("name"))
        .when(kind_is("if"), F.col("trigger"))
        .otherwise(F.col("object"))
    )
    return facts.withColumn("ns", ns).withColumn("nm", nm)


def _of_names() -> dict[str, Column]:
    """What is known of a name: aggregates over its facts in one program."""
    outside = ~F.col("in_draw")
    return {
        "decl": F.min(F.when(kind_is("declare"), F.struct("seq", "call", "end"))),
        "changed_in_draw": F.max(is_change() & F.col("in_draw")),
        "animated": F.max(kind_is("method") & (F.col("name") == "setAnimation") & outside),
        "velocity": F.max(F.coalesce(F.col("property").contains("velocity"), F.lit(False)) & is_change() & outside),
        "n_random": F.count_if(_moves() & F.col("random")),
        "n_counter": F.count_if(_moves() & F.col("counter")),
        "last_draw": F.max("draw_end"),
        "n_calls": F.count_if(kind_is("call")),
        "n_defs": F.count_if(kind_is("function")),
        "n_open_defs": F.count_if(kind_is("function") & ~F.coalesce("seen_draw", F.lit(False))),
        "n_cond_draw": F.count_if(kind_is("if") & F.col("in_draw")),
    }


def _typed(stats: DataFrame) -> DataFrame:
    """Add what a declared name holds and whether it can move."""
    return stats.withColumn("type", F.when(F.col("decl").isNotNull(), declared_type(F.col("decl.call")))).withColumn(
        "moves",
        F.coalesce((F.col("type") != "none") & (F.col("decl.end") <= F.col("last_draw")), F.lit(False)),
    )


def name_stats(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Per program and name: first declaration, changes, calls, movement."""
    named = with_name_key(facts).where(F.col("ns").isNotNull())
    stats = named.groupBy(*keys, "ns", "nm").agg(*[value.alias(name) for name, value in _of_names().items()])
    return _typed(stats).withColumnRenamed("last_draw", "draw_end")


def _of_programs(row: Column, over: Callable[[Column], Column]) -> dict[str, Column]:
    """``FEATURES``: figures of a program's names, the rows of ``row``; ``over`` completes an aggregate."""
    obj, fun, trig = (row & (F.col("ns") == ns) for ns in ("object", "function", "trigger"))
    count = lambda condition: over(F.count_if(condition))
    total = lambda column, condition: F.coalesce(over(F.sum(F.when(condition, F.col(column)))), F.lit(0))
    sprite = obj & (F.col("type") == "sprite")
    defined = fun & (F.col("n_defs") > 0)
    return {
        "sprites": count(sprite),
        "shapes": count(obj & (F.col("type") == "shape")) + total("n_calls", fun & F.col("nm").isin(SHAPE_FUNCTIONS)),
        "texts": count(obj & (F.col("type") == "text")) + total("n_calls", fun & (F.col("nm") == "text")),
        "counted_shapes": count(fun & F.col("nm").isin(COUNTED_SHAPES) & (F.col("n_calls") > 0)),
        "sprites_updated": count(sprite & F.col("changed_in_draw")),
        "sprites_animated": count(sprite & F.col("animated")),
        "sprites_with_velocity": count(sprite & F.col("velocity")),
        "random": total("n_random", obj & F.col("moves")),
        "counter": total("n_counter", obj & F.col("moves")),
        "cond_draw": total("n_cond_draw", trig),
        "cond_user": total("n_cond_draw", trig & (F.col("nm") == "user")),
        "cond_variable": total("n_cond_draw", trig & (F.col("nm") == "variable")),
        "cond_object": total("n_cond_draw", trig & (F.col("nm") == "object")),
        "functions": total("n_open_defs", fun),
        "functions_called": count(defined & (F.col("n_calls") > 0)),
        "functions_called_again": count(defined & (F.col("n_calls") > 1)),
    }


def program_features(stats: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """The numbers the rules look at, from ``name_stats``."""
    return stats.groupBy(*keys).agg(*[value.alias(name) for name, value in _of_programs(F.lit(True), lambda value: value).items()])


def with_figures(facts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Facts of names with the columns of ``name_stats`` and, as ``features``, ``program_features``.

    The facts of a program are moved once and ordered once for both; a program has its
    facts in one task already when it is scanned.
    """
    by_name = W.partitionBy(*keys, "ns", "nm").orderBy("seq")
    whole = by_name.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = with_name_key(facts).where(F.col("ns").isNotNull())
    columns = {name: value.over(whole) for name, value in _of_names().items()} | {"first": F.row_number().over(by_name) == 1}
    # Ordered like the names, although its frame is the whole program, so that one sort serves both.
    program = W.partitionBy(*keys).orderBy("ns", "nm", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = _of_programs(F.col("first"), lambda value: value.over(program))
    return _typed(named.withColumns(columns)).withColumn("features", F.struct(*[value.alias(name) for name, value in counts.items()]))
