"""Student programs -> one row per statement ("facts").

A program is cut into statements with SQL string functions. Line numbers,
bracket depth, block ends and the draw loop come from window functions over
the statements of one program, so a corpus needs one shuffle on the program
key. A program is a single text value, so its statements always fit one task.

Fact columns (besides the program key):
  seq, kind, start, end         place; kind is function, if, declare, call,
                                method, assign, update or unparsed
  done                          place of the statement's last character, so an
                                inner block comes before the one around it
  name, object, property, op    what is declared, called or changed
  call, args, value             function on the right side, argument text, text
  trigger                       if: variable, object, user or untracked
  counter, random               assign/update: shape of the right side
  in_draw, draw_end             inside the draw function, and its last line
  seen_draw                     function: starts on the last line of a finished
                                draw function
  move_start, move_end          lines to report for movement in the draw loop;
                                NULL where the statement is not looked at

A body without braces is a block like any other: ``if (a) x();`` and the same with braces
give equal facts. Round brackets may nest to any depth and a declaration may name any number of
variables; names without a value have a NULL value. Declarations in loop heads
and of function expressions count as well. Statements outside the recognised
shapes become kind 'unparsed' and never stop a job.

Unreadable text spoils what is near it only. A backtick or comment that never ends
goes to the end of its line. In a program with more opening than closing braces every
line that begins with a function starts an island of its own: blocks that are open
there end before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.dims import FUNCTION_ARGS, STUDENT_KEY, lit_array
from tallymark.functions.expressions import let, with_once
from tallymark.functions.text import strip

# Quoted text and comments first, so that brackets inside them do not count.
_TOKEN = (
    r"""(?s)"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|`(?:[^`\\]++|\\.)*+`?"""
    r"""|/\*.*?(?:\*/|\z)|//[^\n]*+|[^"'`/]++|/"""
)
# The same for what follows a backtick or comment that never ends: quotes stay on their line.
_LINE_QUOTES = r"""(?s)"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|`(?:[^`\\\n]++|\\.)*+`?"""
_TOKEN_ON_LINE = {
    "`": _LINE_QUOTES + r"""|/\*.*?(?:\*/|\z)|//[^\n]*+|[^"'`/]++|/""",
    "/*": _LINE_QUOTES + r"""|/\*[^\n]*+|//[^\n]*+|[^"'`/]++|/""",
}
# Stand-ins for significant characters inside quotes (private-use code points).
_SIGNIFICANT = "{};(),\n"
_STAND_INS = "".join(chr(0xE000 + i) for i in range(len(_SIGNIFICANT)))
# Stand-ins for balanced round brackets inside other round brackets, so that
# patterns meet one level only, however deep the nesting.
_OPEN, _CLOSE, _COMMA = "\ue010", "\ue011", "\ue012"
_DISGUISED, _PLAIN = _STAND_INS + _OPEN + _CLOSE + _COMMA, _SIGNIFICANT + "(),"

_ID = r"[A-Za-z_$][\w$]*+"
_ARGS = r"[^()]*+"
_CALL = rf"{_ID}(?:\.{_ID})?\s*+\({_ARGS}\)"
_MEMBER = rf"{_ID}\.{_ID}"
_LITERAL = r"""(?:\d++(?:\.\d*+)?|\.\d++|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|(?:true|false|null)(?![\w$]))"""
_UNARY = rf"[-+!~]\s*+(?:{_LITERAL}|{_MEMBER}|{_ID})"
_OPERAND = rf"(?:{_CALL}|{_MEMBER}|{_LITERAL}|{_ID}|{_UNARY})"
_BINARY = rf"(?s)^({_OPERAND})\s*+(===|!==|==|!=|<=|>=|<<|>>|<|>|[-+*/%&|^])\s*+({_OPERAND})$"


# Virtual braces around a body without braces, and a mark before what ends a statement
# that an else follows.
_VIRTUAL_OPEN, _VIRTUAL_CLOSE, _ELSE_FOLLOWS = "\ue020", "\ue021", "\ue022"
_OPENS, _CLOSES = "{" + _VIRTUAL_OPEN, "}" + _VIRTUAL_CLOSE
_TERMS = ";\n" + _OPENS + _CLOSES
# Heads whose next character starts a statement; a while behind a brace ends a do loop.
_BARE_HEAD = (
    rf"(?<![\w$.])((?:else\s++)?if\s*+\({_ARGS}\)|for\s*+\({_ARGS}\)"
    rf"|(?<!\}}[ \t]{{0,9}})while\s*+\({_ARGS}\))(?=\s*+[^\s{{}};])"
)
_BARE_ELSE = r"(^|[;}\n])(\s*+)else(?=\s++(?!if\s*+\()[^\s{};])"
_BEFORE_ELSE = r"([;}\n])(?=\s*+else(?![\w$]))"

# A line goes on after a trailing operator, and from a header to its brace on
# the next line; such line ends get a stand-in.
_LINE_END = _STAND_INS[-1]
_AFTER_OPERATOR = r"((?<!\+)\+|(?<!-)-|[*/%=<>&|,.])[ \t]*+\n"
_BEFORE_BRACE = r"\n(?=[ \t]*+\n?[ \t]*+\{)"
# Up to a ; { } or line end outside round brackets.
_PIECE = rf"\s*+(?:[^()\n;{_OPENS}{_CLOSES}]++|\({_ARGS}\)|[()])*+[;\n{_OPENS}{_CLOSES}]?"
_CASE_LABEL = r"^(?:case\s[^:]*+|default\s*+):\s*+"

# One match gives all parts of a statement, in the order of _PARTS.
_STATEMENT = (
    rf"(?s)^(?:(?:var|let|const)\s++(.+)|({_ID})(?:\.({_ID}))?\s*+\(({_ARGS})\)|(\+\+|--)\s*+({_ID})(?:\.({_ID}))?"
    rf"|({_ID})(?:\.({_ID}))?\s*+(?:(\+\+|--)|([-+*/%]?=)(?!=)\s*+(.+)))$"
)
_PARTS = ["declared", "callee", "callee_method", "call_args", "pre_op", "pre_id", "pre_prop", "id", "prop", "post_op", "set_op", "rhs"]
_DECLARATOR = rf"(?s)^({_ID})\s*+(?:=\s*+(.*))?$"
# Commas inside round brackets have stand-ins; a bare name is not inside square ones.
_NEXT_DECLARATOR = rf",\s*+(?={_ID}\s*+(?:=[^=]|,(?![^\[\]]*+\])|$))"
# Declarations in the head of a loop, and of function expressions.
_LOOP_HEAD = r"(?s)^for\s*+\(\s*+(?:var|let|const)\s++(.*?)\s*(?:;.*|\s(?:of|in)\s.*)\)$"
_FUNCTION_VALUE = rf"(?s)^(?:var|let|const)\s++({_ID})\s*+=\s*+(?:async\s++)?function(?![\w$]).*$"
_PLAIN_CALL = rf"(?s)^({_ID})\s*+\(({_ARGS})\)$"
_NOT_CALLS = ["if", "while", "for", "switch", "return", "function", "catch"]
# Place of a closing brace that is not there.
_OPEN_ENDED = 1 << 31
# A text has fewer characters than this, so parts of a statement never reach the next.
_PARTS_OF_STATEMENT = 1 << 31


def _split_match(text: Column, pattern: str, n_groups: int) -> Column:
    """Groups of a whole-text match as an array, NULL when there is no match."""
    joined = F.regexp_replace(text, pattern, "\x01".join(f"${g}" for g in range(1, n_groups + 1)))
    # Matched once: inside generated columns nothing else keeps the search from running twice.
    return let(
        F.split(joined, "\x01", -1),
        lambda parts: F.when(F.size(parts) == n_groups, F.transform(parts, lambda p: F.nullif(p, F.lit("")))),
    )


def _tokens(code: Column) -> Column:
    """Tokens of a program; only the last one can be a backtick or comment without end."""

    def restarted(tokens: Column) -> Column:
        last = F.get(tokens, F.size(tokens) - 1)
        rest = lambda pattern: F.regexp_extract_all(
            F.regexp_extract(last, r"(?s)^[^\n]*+(.*)\z", 1), F.lit(pattern), F.lit(0)
        )
        on_line = F.concat(F.slice(tokens, 1, F.size(tokens) - 1), F.array(F.regexp_extract(last, r"^[^\n]*+", 0)))
        return (
            F.when(last.rlike(r"(?s)^/\*(?!.*\*/\z)"), F.concat(on_line, rest(_TOKEN_ON_LINE["/*"])))
            .when(last.rlike(r"(?s)^`(?:[^`\\]++|\\.)*+\z"), F.concat(on_line, rest(_TOKEN_ON_LINE["`"])))
            .otherwise(tokens)
        )

    return let(F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(0)), restarted)


def mask_code(code: Column) -> Column:
    """Blank comments (line breaks stay) and disguise brackets inside quotes."""
    return F.array_join(
        F.transform(
            _tokens(code),
            lambda t: F.when(t.startswith("/*") | t.startswith("//"), F.regexp_replace(t, r"[^\n]+", " "))
            .when(F.substring(t, 1, 1).isin('"', "'", "`"), F.translate(t, _SIGNIFICANT, _STAND_INS))
            .otherwise(t),
        ),
        "",
    )


def _unmask(text: Column) -> Column:
    # Translating is slow per character and hardly ever needed.
    disguised = text.rlike(f"[{_DISGUISED[0]}-{_DISGUISED[-1]}]")
    return F.when(disguised, F.translate(text, _DISGUISED, _PLAIN)).otherwise(text)


def _outer_brackets(text: Column) -> Column:
    """Show the outermost pairs of disguised brackets; disguise the commas in them."""
    state = lambda depth, out: F.struct(depth.alias("depth"), out.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        mark = F.right(piece, F.lit(1))
        opens, closes = mark == _OPEN, mark == _CLOSE
        inner = F.when(acc["depth"] > 0, F.replace(piece, F.lit(","), F.lit(_COMMA))).otherwise(
            F.replace(piece, F.lit(_COMMA), F.lit(","))
        )
        shown = (
            F.when(opens & (acc["depth"] == 0), F.replace(inner, F.lit(_OPEN), F.lit("(")))
            .when(closes & (acc["depth"] == 1), F.replace(inner, F.lit(_CLOSE), F.lit(")")))
            .otherwise(inner)
        )
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return state(depth, F.concat(acc["out"], shown))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[^{_OPEN}{_CLOSE}]++[{_OPEN}{_CLOSE}]?|[{_OPEN}{_CLOSE}]"), F.lit(0))
    walked = F.aggregate(pieces, state(F.lit(0), F.lit("")), step, lambda acc: acc["out"])
    return F.when(text.contains(_OPEN) | text.contains(_COMMA), walked).otherwise(text)


def mask_brackets(masked: Column) -> Column:
    """Leave only the outermost balanced round brackets of masked code.

    Innermost pairs are disguised first, level by level (as many rounds as the
    text is deep); then the outermost are shown again. Brackets without partner
    stay as they are.
    """
    state = lambda depth, most: F.struct(depth.alias("depth"), most.alias("most"))

    def deeper(acc: Column, mark: Column) -> Column:
        depth = F.when(mark == "(", acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        return state(depth, F.greatest(acc["most"], depth))

    def disguised(text: Column) -> Column:
        def rounds(marks: Column) -> Column:
            depth = F.aggregate(marks, state(F.lit(0), F.lit(0)), deeper, lambda acc: acc["most"])
            return F.least(depth, F.size(F.filter(marks, lambda m: m == ")")))

        found = let(F.regexp_extract_all(text, F.lit("[()]"), F.lit(0)), rounds)
        levels = let(found, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
        return F.aggregate(levels, text, lambda t, _: F.regexp_replace(t, r"\(([^()]*+)\)", f"{_OPEN}$1{_CLOSE}"))

    return let(masked, lambda text: let(disguised(text), _outer_brackets))


def close_bare_bodies(masked: Column) -> Column:
    """Give bodies without braces virtual ones, so that they have a range of their own.

    ``if (a) x();``, ``else y();`` and loops alike, on the same line or the next. The
    body ends with the next complete statement; what it completes ends with it, but
    for an ``if`` that an ``else`` follows. The open blocks are a stack of letters:
    B braces, V a virtual block of an if, W one of anything else.
    """
    state = lambda stack, out: F.struct(stack.alias("stack"), out.alias("out"))
    mark_of = lambda n: F.repeat(F.lit(_VIRTUAL_CLOSE), n)

    def ended(stack: Column, piece: Column) -> Column:
        """How many virtual blocks end with a statement."""
        own = F.regexp_extract(stack, "(VW*)$", 1)
        return F.length(F.when(piece.contains(_ELSE_FOLLOWS), own).otherwise(F.regexp_extract(stack, "([VW]*)$", 1)))

    def step(acc: Column, piece: Column) -> Column:
        mark, stack, out = F.right(piece, F.lit(1)), acc["stack"], acc["out"]
        body = F.substring(piece, F.lit(1), F.length(piece) - 1)
        cut = lambda text, n: F.substring(text, F.lit(1), F.length(text) - n)
        virtual = F.when(piece.rlike(r"(?<![\w$])if\s*+\("), "V").otherwise("W")
        within = F.length(F.regexp_extract(stack, "([VW]*)$", 1))  # ends before a brace does
        outer = cut(stack, F.least(within + 1, F.length(stack)))
        after = ended(outer, piece)
        done = ended(stack, piece)
        return (
            F.when(mark == "{", state(F.concat(stack, F.lit("B")), F.concat(out, piece)))
            .when(mark == _VIRTUAL_OPEN, state(F.concat(stack, virtual), F.concat(out, piece)))
            .when(mark == "}", state(cut(outer, after), F.concat(out, body, mark_of(within), mark, mark_of(after))))
            .when(~piece.rlike(rf"[^\s{_ELSE_FOLLOWS}]"), state(stack, F.concat(out, piece)))
            .when(mark == "\n", state(cut(stack, done), F.concat(out, body, mark_of(done), mark)))
            .otherwise(state(cut(stack, done), F.concat(out, piece, mark_of(done))))
        )

    def closed(code: Column) -> Column:
        marked = F.regexp_replace(code, _BEFORE_ELSE, f"{_ELSE_FOLLOWS}$1")
        pieces = F.regexp_extract_all(marked, F.lit(_PIECE), F.lit(0))
        walked = F.aggregate(pieces, state(F.lit(""), F.lit("")), step, lambda acc: acc["out"])
        return F.when(code.contains(_VIRTUAL_OPEN), F.replace(walked, F.lit(_ELSE_FOLLOWS), F.lit(""))).otherwise(code)

    heads = F.regexp_replace(masked, _BARE_HEAD, f"$1{_VIRTUAL_OPEN}")
    return let(F.regexp_replace(heads, _BARE_ELSE, f"$1$2else{_VIRTUAL_OPEN}"), closed)


def close_islands(masked: Column) -> Column:
    """End open blocks where a program that lacks closing braces starts again.

    It starts again at a line that begins with a named function. Programs whose braces
    balance stay as they are, also with such functions inside others; closing braces
    that are too many need no care, as levels are compared with each other only.
    """
    missing = lambda text: F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))

    def ended(island: Column) -> Column:
        code = F.regexp_replace(island, r"\s++$", "")
        marks = F.repeat(F.lit(_VIRTUAL_CLOSE), F.greatest(missing(island), F.lit(0)))
        return F.concat(code, marks, F.substring(island, F.length(code) + 1, F.length(island)))

    def closed(code: Column) -> Column:
        islands = F.split(code, rf"(?m)^(?=function\s++{_ID}\s*+\()", -1)
        last = F.size(islands) - 1
        ends = F.transform(islands, lambda island, n: F.when(n < last, ended(island)).otherwise(island))
        return F.when(missing(code) > 0, F.array_join(ends, "")).otherwise(code)

    return let(masked, closed)


def _count_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def statements(programs: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per statement: text, terminator, line breaks before and inside.

    Balanced round brackets keep a statement together over lines; brackets that
    never close are ordinary characters, so they spoil one statement only.
    """
    code = mask_brackets(mask_code(F.regexp_replace(F.col("code"), "\r\n?", "\n")))
    code = close_islands(close_bare_bodies(code))
    code = F.regexp_replace(code, _AFTER_OPERATOR, f"$1{_LINE_END}")
    code = F.regexp_replace(code, _BEFORE_BRACE, _LINE_END)
    pieces = F.regexp_extract_all(code, F.lit(_PIECE), F.lit(0))
    rows = programs.select(*keys, F.posexplode(pieces).alias("pos", "piece")).where(F.col("piece") != "")
    term = F.when(F.right("piece", F.lit(1)).isin(*_TERMS), F.right("piece", F.lit(1))).otherwise("")
    raw = F.replace("piece", F.lit(_LINE_END), F.lit("\n"))
    body = F.ltrim(F.substring(raw, F.lit(1), F.length(raw) - F.length("term")), F.lit(" \t\n\x0b\f"))
    return (
        rows.withColumn("term", term)
        .withColumn("breaks", _count_breaks(raw))
        .withColumn("text", F.regexp_replace(strip(body), _CASE_LABEL, ""))
        .withColumn("inside", _count_breaks(body))
        .withColumn("lead", F.col("breaks") - F.col("inside") - (F.col("term") == "\n").cast("int"))
        .drop("piece")
    )


def blocks(stmts: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Add nesting: depth, block kind and end, draw loop, movement lines."""
    program = W.partitionBy(*keys).orderBy("pos")
    before = program.rowsBetween(W.unboundedPreceding, -1)
    opens, closes = F.col("term").isin(*_OPENS), F.col("term").isin(*_CLOSES)
    text = F.col("text")
    kind = F.when(
        opens,
        F.when(text.rlike(rf"(?s)^function\s++{_ID}\s*+\({_ARGS}\)$"), "function")
        .when(text.rlike(rf"(?s)^if\s*+\({_ARGS}\)$"), "if")
        .when(text.rlike(rf"(?s)^else\s++if\s*+\({_ARGS}\)$"), "else_if")
        .when(text == "else", "else")
        .otherwise("block"),
    )
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    leveled = (
        stmts.withColumn("block", kind)
        .withColumn("start", 1 + F.coalesce(F.sum("breaks").over(before), F.lit(0)) + F.col("lead"))
        .withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
        .where((F.col("text") != "") | opens | closes)
        .withColumn("end", F.col("start") + F.col("inside"))
        .withColumn("level", F.when(closes, F.col("depth") - 1).otherwise(F.col("depth")))
        .withColumn("brace", opens | closes)
        .withColumn("last_line", F.max("end").over(W.partitionBy(*keys)))
    )
    # At one level, opening and closing braces alternate.
    same_level = W.partitionBy(*keys, "brace", "level").orderBy("pos")
    following = F.lead(F.when(closes, F.struct("end", "pos"))).over(same_level)
    begins = opens & ~F.col("block").isin("else", "else_if")
    last_of = lambda here: F.coalesce(F.max(F.when(here, F.col("pos"))).over(same_level), F.lit(-1))
    chained = (
        leveled.withColumn("close", following)
        .withColumn("block_end", F.when(opens, F.coalesce("close.end", "last_line")))
        .withColumn("block_close", F.when(opens, F.coalesce(F.col("close.pos"), F.lit(_OPEN_ENDED))))
        .withColumn("chain", F.sum(F.when(begins, 1).otherwise(0)).over(same_level))
        .withColumn("after_else_if", last_of(F.col("block") == "else_if") > last_of(begins))
    )
    # Ordered, although two of its frames are the whole chain, so that one sort serves all.
    chain = W.partitionBy(*keys, "brace", "level", "chain").orderBy("pos")
    whole = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    closed = (
        chained.withColumn("chain_end", F.max("block_end").over(whole))
        .withColumn("chain_close", F.max("block_close").over(whole))
        .withColumn("name", F.when(F.col("block") == "function", F.regexp_extract("text", rf"^function\s++({_ID})", 1)))
        .withColumn(
            "stmt_end",
            F.when(F.col("block") == "function", F.col("block_end"))
            .when(F.col("block").isin("if", "else_if"), F.col("chain_end"))
            .otherwise(F.col("end")),
        )
    )
    is_draw = F.col("name") == "draw"
    draw = F.max(
        F.when(is_draw, F.struct("pos", F.col("start").alias("from"), F.col("block_end").alias("to"), "level"))
    ).over(program)
    inside = (
        (F.col("pos") > F.col("draw.pos"))
        & (F.col("start") >= F.col("draw.from"))
        & (F.col("stmt_end") <= F.col("draw.to"))
        & (F.col("depth") > F.col("draw.level"))
    )
    in_draw = closed.withColumn("draw", draw).withColumn(
        "in_draw", F.coalesce(inside, F.lit(False)) & ~F.coalesce(is_draw, F.lit(False))
    )
    # Movement looks through if and else, not into other blocks of the loop.
    hidden = (
        opens
        & F.col("in_draw")
        & (F.col("block").isin("function", "else_if", "block") | ((F.col("block") == "else") & F.col("after_else_if")))
    )
    outer_if = F.max(
        F.when(
            (F.col("block") == "if") & F.col("in_draw") & (F.col("level") == F.col("draw.level") + 1),
            F.struct("pos", F.col("start").alias("from"), F.col("chain_end").alias("to")),
        )
    ).over(program)
    return (
        in_draw.withColumn("hidden", hidden)
        # What a hidden block hides ends at its brace, whatever the blocks inside it do.
        .withColumn("hiding", F.coalesce(F.max(F.when(F.col("hidden"), F.col("block_close"))).over(before) >= F.col("pos"), F.lit(False)))
        .withColumn("outer_if", outer_if)
    )


def _operand_class(text: Column) -> Column:
    return (
        F.when(text.rlike(rf"(?s)^{_CALL}$"), "call")
        .when(text.rlike(rf"^{_MEMBER}$"), "object")
        .when(text.rlike(rf"(?s)^{_LITERAL}$"), "literal")
        .when(text.rlike(rf"^{_ID}$"), "identifier")
        .otherwise("other")
    )


def _trigger(test: Column, binary: Column) -> Column:
    """What makes a conditional fire.

    In a comparison a variable counts before an object property and that
    before a call; any call counts as user interaction.
    """
    operands = F.when(binary.isNull(), F.array(test)).otherwise(F.array(F.get(binary, F.lit(0)), F.get(binary, F.lit(2))))
    classes = F.transform(operands, _operand_class)
    return let(
        classes,
        lambda c: F.when(F.array_contains(c, "identifier"), "variable")
        .when(F.array_contains(c, "object"), "object")
        .when(F.array_contains(c, "call"), "user")
        .otherwise("untracked"),
    )


def facts(programs: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Scan programs (key columns and ``code``) to facts.

    The programs' texts move, not their statements, and to the session's number of shuffle
    partitions: statements take many times the memory of the bytes that move, by whose
    size partitions would be merged.
    """
    n = int(programs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nested = blocks(statements(programs.repartition(n, *keys), keys), keys)
    block, text = F.col("block"), F.col("text")
    head = F.nullif(F.regexp_extract(text, _LOOP_HEAD, 1), F.lit(""))
    function_value = F.nullif(F.regexp_extract(text, _FUNCTION_VALUE, 1), F.lit(""))
    nested = nested.withColumn("head", F.when(block == "block", F.coalesce(_outer_brackets(head), function_value)))
    plain = nested.where(
        block.isin("function", "if", "else_if") | F.col("head").isNotNull() | (block.isNull() & (text != ""))
    )
    parsed = with_once(plain, m=F.when(block.isNull(), _split_match(text, _STATEMENT, len(_PARTS))))
    part = {name: F.get("m", F.lit(n)) for n, name in enumerate(_PARTS)}
    part["declared"] = F.coalesce(part["declared"], F.col("head"))
    kind = (
        F.when(block == "function", "function")
        .when(part["declared"].isNotNull(), "declare")
        .when(block.isNotNull(), "if")
        .when(part["callee_method"].isNotNull(), "method")
        .when(part["callee"].isNotNull() & ~part["callee"].isin(_NOT_CALLS), "call")
        .when(part["pre_op"].isNotNull() | part["post_op"].isNotNull(), "update")
        .when(part["set_op"].isNotNull(), "assign")
        .otherwise("unparsed")
    )
    test = F.regexp_extract(text, rf"(?s)^(?:else\s++)?if\s*+\(({_ARGS})\)$", 1)
    values = (
        F.when(part["declared"].isNotNull(), F.split(part["declared"], _NEXT_DECLARATOR, -1))
        .when(block.isin("if", "else_if"), F.array(_outer_brackets(test)))
        .when(part["rhs"].isNotNull(), F.array(part["rhs"]))
        .when(block.isNull() & F.col("m").isNull(), F.array(text))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    rows = parsed.withColumn("kind", kind).select("*", F.posexplode(values).alias("_i", "_value"))
    is_kind = lambda *k: F.col("kind").isin(*k)
    declared = F.when(is_kind("declare"), _split_match(F.col("_value"), _DECLARATOR, 2))
    named = with_once(rows, d=declared).withColumn(
        "value", F.when(is_kind("declare"), F.get("d", F.lit(1))).otherwise(F.col("_value"))
    )
    ready = with_once(
        named,
        c=F.when(is_kind("declare", "assign"), _split_match(F.col("value"), _PLAIN_CALL, 2)),
        b=F.when(is_kind("if", "assign"), _split_match(F.col("value"), _BINARY, 3)),
    )
    target = F.coalesce(part["id"], part["pre_id"])
    prop = F.coalesce(part["prop"], part["pre_prop"])
    member = F.concat(target, F.lit("."), prop)
    left, op, right = (F.get("b", F.lit(g)) for g in (0, 1, 2))
    calls_random = lambda operand: F.coalesce(operand.rlike(r"^[\w$]*randomNumber[\w$]*\s*\("), F.lit(False))
    counter = F.when(is_kind("update"), prop.isNotNull()).when(
        is_kind("assign"), F.coalesce(op.isin("+", "-") & ((left == member) | (right == member)), F.lit(False))
    )
    call = F.get("c", F.lit(0))
    random = F.when(
        is_kind("assign"), calls_random(left) | calls_random(right) | F.coalesce(call == "randomNumber", F.lit(False))
    )
    visible = F.col("in_draw") & ~F.col("hiding") & is_kind("assign", "update")
    direct = F.col("depth") == F.col("draw.level") + 1
    place = F.col("pos").cast("bigint") * _PARTS_OF_STATEMENT + F.col("_i")
    last_of = lambda pos: pos * _PARTS_OF_STATEMENT + (_PARTS_OF_STATEMENT - 1)
    seen = (
        is_kind("function")
        & (F.col("pos") > F.col("draw.pos"))
        & (F.col("depth") <= F.col("draw.level"))
        & F.col("start").between(F.col("draw.from"), F.col("draw.to"))
    )
    changed = is_kind("assign", "update")
    args = F.when(is_kind("call", "method"), F.coalesce(part["call_args"], F.lit(""))).when(
        call.isNotNull(), F.coalesce(F.get("c", F.lit(1)), F.lit(""))
    )
    return ready.select(
        *keys,
        place.alias("seq"),
        "kind",
        F.col("start").cast("int").alias("start"),
        F.col("stmt_end").cast("int").alias("end"),
        F.when(is_kind("function"), F.col("name"))
        .when(is_kind("declare"), F.get("d", F.lit(0)))
        .when(is_kind("call"), part["callee"])
        .when(is_kind("method"), part["callee_method"])
        .when(changed & prop.isNull(), target)
        .alias("name"),
        F.when(is_kind("method"), part["callee"]).when(changed & prop.isNotNull(), target).alias("object"),
        F.when(changed, prop).alias("property"),
        F.when(changed, F.coalesce(part["set_op"], part["pre_op"], part["post_op"])).alias("op"),
        call.alias("call"),
        _unmask(args).alias("args"),
        _unmask(F.col("value")).alias("value"),
        F.when(is_kind("if"), _trigger(F.col("value"), F.col("b"))).alias("trigger"),
        counter.alias("counter"),
        random.alias("random"),
        "in_draw",
        F.when(F.col("in_draw"), F.col("draw.to")).cast("int").alias("draw_end"),
        F.coalesce(seen, F.lit(False)).alias("seen_draw"),
        F.when(is_kind("function"), last_of(F.col("block_close").cast("bigint")))
        .when(is_kind("if"), last_of(F.col("chain_close").cast("bigint")))
        .otherwise(place)
        .alias("done"),
        F.when(visible, F.when(direct, F.col("start")).otherwise(F.col("outer_if.from"))).cast("int").alias("move_start"),
        F.when(visible, F.when(direct, F.col("stmt_end")).otherwise(F.col("outer_if.to"))).cast("int").alias("move_end"),
    )


def named_args(name: Column, args: Column) -> Column:
    """Argument names of a drawing function with the argument texts.

    Only literals, names and calls are taken; other arguments are passed over,
    which shifts the following ones. ARRAY<STRUCT<name, value>>.
    """
    names = F.lit(None).cast("array<string>")
    for function, arg_names in FUNCTION_ARGS.items():
        names = F.when(name == function, lit_array(arg_names)).otherwise(names)
    masked = mask_brackets(mask_code(args))
    pieces = F.regexp_extract_all(masked, F.lit(rf"(?s)(?:[^,()]++|\({_ARGS}\))++"), F.lit(0))
    kept = F.filter(
        F.transform(pieces, lambda a: F.trim(a)), lambda a: a.rlike(rf"(?s)^(?:{_CALL}|{_LITERAL}|{_ID})$")
    )
    taken = F.slice(F.transform(kept, _unmask), F.lit(1), F.size(names))
    return F.transform(taken, lambda v, i: F.struct(F.get(names, i).alias("name"), v.alias("value")))
