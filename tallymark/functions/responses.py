"""Provider envelopes: HTTP outcome, choices, token usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE_TYPE = (
    "struct<"
    "choices:array<struct<message:struct<content:string>,finish_reason:string>>,"
    "content:array<struct<type:string,text:string>>,"
    "completion:string,generation:string,stop_reason:string,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,"
    "error:struct<message:string,code:string>>"
)
CHOICES_TYPE = "array<struct<content:string,finish_reason:string>>"


def envelope(body: Column) -> Column:
    """The parts of a response body that are read, for every provider."""
    return F.from_json(body, ENVELOPE_TYPE)


def http_outcome(status: Column, env: Column) -> Column:
    """server_error, too_large, failed or ok."""
    return (
        F.when(status == 500, "server_error")
        .when((status == 400) & (env["error"]["code"] == "context_length_exceeded"), "too_large")
        .when(status != 200, "failed")
        .otherwise("ok")
    )


def _choice(content: Column, finish: Column) -> Column:
    return F.struct(content.alias("content"), finish.alias("finish_reason"))


def repair_stretch(text: Column) -> Column:
    """Escaped quotes around one word break the JSON of some answers."""
    return F.replace(text, F.lit('\\"Stretch\\"'), F.lit("“Stretch”"))


def choices(env: Column) -> Column:
    """ARRAY<STRUCT<content, finish_reason>> whichever provider answered."""
    stop = env["stop_reason"]
    return (
        F.when(
            env["choices"].isNotNull(),
            F.transform(env["choices"], lambda c: _choice(c["message"]["content"], c["finish_reason"])),
        )
        .when(env["completion"].isNotNull(), F.array(_choice(env["completion"], stop)))
        .when(
            env["content"].isNotNull(),
            F.array(_choice(repair_stretch(F.get(env["content"], F.lit(0))["text"]), stop)),
        )
        .when(env["generation"].isNotNull(), F.array(_choice(env["generation"], stop)))
        .cast(CHOICES_TYPE)
    )


def total_tokens(env: Column) -> Column:
    return F.coalesce(env["usage"]["total_tokens"], F.lit(0).cast("bigint"))
