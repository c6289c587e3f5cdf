from pyspark.sql import functions as F

from tallymark.functions import labels, prompts, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_comments_go_and_strings_stay(spark):
    code = (
        'function f() {\n  var a = "\\"// no";\n  var b = "say w\\"ith /* no */ inside.";\n'
        "  var c = 'also // no';\n  // gone\n  /* gone\n   too */\n  return a;\n}\n"
    )
    want = (
        'function f() {\n  var a = "\\"// no";\n  var b = "say w\\"ith /* no */ inside.";\n'
        "  var c = 'also // no';\n  \n  \n  return a;\n}\n"
    )
    assert one(spark, text.remove_comments(F.col("c")), c=code) == want


def test_strip_takes_unicode_space(spark):
    odd = "\u2003 \x1c\tword two\xa0\n\u3000"
    assert one(spark, text.strip(F.col("c")), c=odd) == odd.strip() == "word two"
    assert one(spark, text.strip_value(F.col("c")), c=' "q"" \n') == "q"
    assert one(spark, text.is_blank(F.col("c")), c="\u2003\x1f\n") is True
    assert one(spark, text.is_blank(F.col("c")), c=" x ") is False


def test_evidence_is_one_line(spark):
    raw = "Line 20, 21, 25: `a()`\n\nLines 5, 6, 7: ```b()``` Line 4: `c\nd`"
    want = "Lines 20-25: `a()`  Lines 5-7: `b()` Line 4: `c d`"
    assert one(spark, text.sanitize_evidence(F.col("c")), c=raw) == want
    assert one(spark, text.sanitize_evidence(F.col("c")), c="Lines 1, 2, 3, 4") == "Lines 1-3, 4"


def test_pass_fail_agreement(spark):
    cases = [
        ("Extensive Evidence", "Extensive Evidence", True),
        ("Extensive Evidence", "Convincing Evidence", True),
        ("Limited Evidence", "No Evidence", True),
        ("Convincing Evidence", "Limited Evidence", False),
        ("No Evidence", "Extensive Evidence", False),
    ]
    for actual, predicted, want in cases:
        assert one(spark, labels.same_class(F.col("a"), F.col("p")), a=actual, p=predicted) is want


def test_colors(spark):
    color = lambda a, p: one(spark, labels.cell_color(F.col("a"), F.col("p"), F.lit("exact")), a=a, p=p)
    assert color("No Evidence", "No Evidence") == "green"
    assert color("No Evidence", "Limited Evidence") == "yellow"
    assert color("No Evidence", "Extensive Evidence") == "red"
    assert color("No Evidence", "what") == "red"
    shade = lambda p: one(spark, labels.accuracy_color(F.col("p").cast("double")), p=p)
    # 50 * 5.1 is a little below 255 in floating point.
    assert int((100 - 50) * 5.1) == 254 and shade("100") == "rgb(1, 255, 1)"
    assert shade("50") == "rgb(255, 255, 255)"
    assert shade("0") == f"rgb(255, {int(-50 * 5.1) + 200}, {int(-50 * 5.1) + 200})"


def test_chat_messages(spark):
    examples = F.array(*[F.struct(F.lit(f"c{n}").alias("code"), F.lit(f"a{n}").alias("answer")) for n in (1, 2)])
    messages = prompts.chat_messages(F.lit("p"), F.lit("r"), F.col("c"), examples)
    got = one(spark, messages, c="code")
    assert [m.role for m in got] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert got[0].content == "p\n\nRubric:\nr" and got[-1].content == "code"
    none = F.lit(None).cast("array<struct<code:string,answer:string>>")
    assert len(one(spark, prompts.chat_messages(F.lit("p"), F.lit("r"), F.col("c"), none), c="x")) == 2
