"""Parsing of one model answer (JSON, TSV, CSV or markdown table) into rows.

Everything here is a Column expression over one answer, so it can run inside
``transform`` over the choices of a response: a response with all its choices
is parsed, checked and voted on where it was read, without a shuffle.

A parsed row is an array of (k, v) entries until it is checked, because header
rows decide the columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.expressions import let
from tallymark.functions.text import starts_alphanumeric, strip, strip_value

# What Python's lenient JSON reader accepts, and nothing more.
JSON_OPTIONS = {"allowUnquotedControlChars": "true", "allowSingleQuotes": "false"}

_ROW_TYPE = (
    "struct<key_concept:string,observations:string,evidence:string,"
    "has_evidence:boolean,label:string,reason:string,columns:array<string>>"
)
ROWS_TYPE = f"array<{_ROW_TYPE}>"


def json_slice(text: Column) -> Column:
    """From the first '[' to the last ']', NULL when there is no such pair."""
    first = F.locate("[", text)
    last = F.length(text) - F.locate("]", F.reverse(text)) + 1
    found = (first > 0) & (F.locate("]", text) > 0) & (last > first)
    return F.when(found, F.substring(text, first, last - first + 1))


def _from_wrapped_json(array_text: Column, element_type: str) -> Column:
    # The wrapper turns text after the closing bracket into a syntax error.
    wrapped = F.concat(F.lit('{"v":'), array_text, F.lit("}"))
    return F.from_json(wrapped, f"v array<{element_type}>", JSON_OPTIONS)["v"]


def parse_json_rows(array_text: Column) -> Column:
    """Array of entry lists, NULL when the text is not a JSON array of objects.

    A list under Evidence becomes its items joined by blanks.
    """
    no_list = F.lit(None).cast("struct<Evidence:array<string>>")

    def entries(row: Column, listed: Column) -> Column:
        joined = F.array_join(listed["Evidence"], " ")
        return F.transform(
            F.map_entries(row),
            lambda e: F.struct(
                e["key"].alias("k"),
                F.when((strip(e["key"]) == "Evidence") & joined.isNotNull(), joined)
                .otherwise(e["value"])
                .alias("v"),
            ),
        )

    def combine(parsed: Column) -> Column:
        rows, lists = parsed["rows"], parsed["lists"]
        return F.when(F.size(lists) == F.size(rows), F.zip_with(rows, lists, entries)).otherwise(
            F.transform(rows, lambda row: entries(row, no_list))
        )

    def parse(text: Column) -> Column:
        rows = _from_wrapped_json(text, "map<string,string>")
        # Only a text with another bracket can hold a list: most are parsed once.
        lists = F.when(F.locate("[", text, 2) > 0, _from_wrapped_json(text, "struct<Evidence:array<string>>"))
        return let(F.struct(rows.alias("rows"), lists.alias("lists")), combine)

    return let(array_text, parse)


def is_json_array(array_text: Column) -> Column:
    """Well-formed JSON array of whatever elements."""
    return _from_wrapped_json(array_text, "string").isNotNull()


def tabular_text(text: Column) -> Column:
    """Cut to the header line, turn escaped and doubled tabs into one tab."""
    cut = F.when(
        text.contains("\nKey Concept"),
        strip(F.substring(text, F.locate("\nKey Concept", text), F.length(text))),
    ).otherwise(text)
    return F.replace(F.replace(cut, F.lit("\\t"), F.lit("\t")), F.lit("\t\t"), F.lit("\t"))


def delimiter(text: Column) -> Column:
    """Tab when there is one, else a spaced pipe, else comma."""
    return F.when(text.contains("\t"), "\t").when(text.contains(" | "), "|").otherwise(",")


def drop_rulers(text: Column) -> Column:
    """Markdown tables lose their ruler lines."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~line.contains("---"))
    return F.when(delimiter(text) == "|", F.array_join(lines, "\n")).otherwise(text)


def _records(text: Column, sep: str) -> Column:
    # A quote opens a quoted part only at the start of a cell.
    pattern = rf'(?s)(?:(?<=^|[{sep}\n])"(?:[^"]++|"")*+(?:"|$)|[^\n"]++|")++'
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: r != "")


def _cells(record: Column, sep: str) -> Column:
    cls = f"[{sep}]"
    pattern = rf'(?s){cls}((?:"(?:[^"]++|"")*+(?:"|$))?+[^{sep}]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(pattern), F.lit(1))
    return F.transform(found, _unquote)


def _unquote(cell: Column) -> Column:
    inner = F.replace(F.regexp_extract(cell, r'(?s)^"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))
    rest = F.regexp_extract(cell, r'(?s)^"(?:[^"]++|"")*+"?(.*)$', 1)
    return F.when(cell.startswith('"'), F.concat(inner, rest)).otherwise(cell)


def _table(text: Column, sep: str) -> Column:
    return F.transform(_records(text, sep), lambda record: _cells(record, sep))


def parse_tabular_rows(text: Column) -> Column:
    """Rows under a header line; short rows get NULLs, extra cells are dropped."""

    def parse(ready: Column) -> Column:
        sep = delimiter(ready)
        table = (
            F.when(sep == "\t", _table(ready, "\t")).when(sep == "|", _table(ready, "|")).otherwise(_table(ready, ","))
        )
        return let(table, _under_header)

    return let(drop_rulers(text), parse)


def _under_header(table: Column) -> Column:
    """Rows of (header cell, cell) entries."""
    header = F.get(table, F.lit(0))
    return F.transform(
        F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))),
        lambda cells: F.transform(
            header, lambda name, i: F.struct(name.alias("k"), F.get(cells, i).alias("v"))
        ),
    )


def sheet_rows(text: Column, sep: str = ",") -> Column:
    """Rows of (header cell, cell) entries of a whole CSV text, as it stands."""
    return let(_table(F.regexp_replace(text, "\r\n?", "\n"), sep), _under_header)


def cell(entries: Column, name: str) -> Column:
    """Value under a header cell; the last one when the header repeats."""
    return _last(F.filter(entries, lambda e: e["k"] == name))["v"]


def _last(entries: Column) -> Column:
    return F.try_element_at(entries, F.lit(-1))


def clean_row(entries: Column) -> Column:
    """Strip keys and values, rename Grade to Label, pick the known columns."""

    def pick(row: Column, key: str) -> Column:
        return _last(F.filter(row, lambda e: e["k"] == key))

    stripped = F.transform(
        entries,
        lambda e: let(
            strip(e["k"]),
            lambda key: F.struct(
                key.alias("k"), strip_value(e["v"]).alias("v"), (key != e["k"]).alias("padded")
            ),
        ),
    )

    # Keys that needed stripping win over the same key written plainly.
    def in_order(row: Column) -> Column:
        padded = F.filter(row, lambda e: e["padded"])
        return F.when(F.size(padded) == 0, row).otherwise(
            F.concat(F.filter(row, lambda e: ~e["padded"]), padded)
        )

    def project(row: Column) -> Column:
        grade, label = pick(row, "Grade"), pick(row, "Label")
        renamed = F.transform(row, lambda e: F.when(e["k"] == "Grade", "Label").otherwise(e["k"]))
        evidence = pick(row, "Evidence")
        return F.struct(
            pick(row, "Key Concept")["v"].alias("key_concept"),
            pick(row, "Observations")["v"].alias("observations"),
            evidence["v"].alias("evidence"),
            evidence.isNotNull().alias("has_evidence"),
            F.when(grade.isNotNull(), grade["v"]).otherwise(label["v"]).alias("label"),
            pick(row, "Reason")["v"].alias("reason"),
            F.array_distinct(renamed).alias("columns"),
        )

    return let(let(stripped, in_order), project)


def _has_column(row: Column, name: str) -> Column:
    return F.array_contains(row["columns"], name)


def is_junk(row: Column) -> Column:
    """A row whose concept does not start with a letter or digit."""
    return _has_column(row, "Key Concept") & ~starts_alphanumeric(row["key_concept"])


def has_null_concept(rows: Column) -> Column:
    """A short row without a concept cell breaks the whole response."""
    return F.exists(rows, lambda r: _has_column(r, "Key Concept") & r["key_concept"].isNull())


def drop_junk_rows(rows: Column) -> Column:
    """Remove junk rows, keeping every second one of an adjacent run.

    The row after a removed one is never looked at, so of k adjacent junk rows
    the 2nd, 4th, ... survive. Pairs are found by one pass over a mask string.
    """
    flags = F.transform(rows, lambda r: F.when(F.coalesce(is_junk(r), F.lit(False)), "J").otherwise("-"))

    def keep(mask: Column) -> Column:
        survivors = F.split(F.replace(F.replace(mask, F.lit("JJ"), F.lit("x-")), F.lit("J"), F.lit("x")), "")
        marked = F.zip_with(rows, survivors, lambda r, m: F.struct(r.alias("r"), m.alias("m")))
        kept = F.filter(marked, lambda p: p["r"].isNotNull() & (p["m"] == "-"))
        return F.when(~F.contains(mask, F.lit("J")), rows).otherwise(F.transform(kept, lambda p: p["r"]))

    return let(F.array_join(flags, ""), keep)


def parse_rows(text: Column, response_type: Column) -> Column:
    """All rows of one answer, cleaned; NULL when the text cannot be read."""

    def read(trimmed: Column) -> Column:
        raw = F.when(response_type == "json", parse_json_rows(json_slice(trimmed))).when(
            response_type == "tsv", let(tabular_text(trimmed), parse_tabular_rows)
        )
        return F.transform(raw, clean_row)

    return let(strip(text), read)


def example_concepts(answer: Column, response_type: Column) -> Column:
    """Distinct concepts of a stored example answer, read without clean-up."""

    def named(rows: Column) -> Column:
        return F.array_distinct(
            F.transform(rows, lambda r: cell(r, "Key Concept"))
        )

    return F.when(response_type == "tsv", let(let(_table(answer, "\t"), _under_header), named)).when(
        response_type == "json", let(parse_json_rows(answer), named)
    )
