"""Prompts, chat messages and request bodies for an external model caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column, rubric: Column, code: Column, examples: Column) -> Column:
    """System text, one user/assistant pair per example, then the program.

    ``examples`` is ARRAY<STRUCT<code, answer>>.
    """
    system = _message("system", F.concat(prompt, F.lit("\n\nRubric:\n"), rubric))
    shown = F.flatten(
        F.transform(
            examples,
            lambda e: F.array(_message("user", e["code"]), _message("assistant", e["answer"])),
        )
    )
    no_examples = F.array().cast(MESSAGES_TYPE)
    return F.concat(
        F.array(system), F.coalesce(shown, no_examples), F.array(_message("user", code))
    ).cast(MESSAGES_TYPE)


# The wording of the two plain prompts.
def anthropic_prompt(prompt: Column, rubric: Column, code: Column) -> Column:
    return F.concat(
        F.lit("Human:\n"), prompt, F.lit("\n\nRubric:\n"), rubric,
        F.lit("\n\nStudent Code:\n"), code, F.lit("\n\nAssistant:\n"),
    )


def meta_prompt(prompt: Column, rubric: Column, code: Column) -> Column:
    return F.concat(
        F.lit("[INST]"), prompt, F.lit("[/INST]\n\nRubric:\n"), rubric,
        F.lit("\n\nStudent Code:\n"), code, F.lit("\n\nEvaluation (JSON):\n"),
    )


def provider(model: Column) -> Column:
    """openai / meta / anthropic by prefix, NULL for an unknown model."""
    return (
        F.when(model.startswith("gpt"), "openai")
        .when(model.startswith("bedrock.meta"), "meta")
        .when(
            model.startswith("bedrock.anthropic") | model.startswith("bedrock.us.anthropic"),
            "anthropic",
        )
    )


def provider_model_id(model: Column, account: str = "", region: str = "us-east-1") -> Column:
    """The id the provider expects: no ``bedrock.`` prefix, newer Claude models by profile."""
    bare = F.substring(model, len("bedrock.") + 1, 1 << 20)
    profile = F.concat(F.lit(f"arn:aws:bedrock:{region}:{account}:inference-profile/"), bare)
    kind = provider(model)
    return (
        F.when(kind == "openai", model)
        .when(kind == "meta", bare)
        .when((kind == "anthropic") & ~model.contains("claude-3"), profile)
        .when(kind == "anthropic", bare)
    )


def request_body(
    model: Column,
    prompt: Column,
    rubric: Column,
    code: Column,
    examples: Column,
    num_responses: Column,
    temperature: Column,
) -> Column:
    """JSON body per provider. A Claude request carries no temperature, n or examples."""
    user_turn = F.struct(
        F.lit("user").alias("role"),
        F.array(
            F.struct(F.lit("text").alias("type"), anthropic_prompt(prompt, rubric, code).alias("text"))
        ).alias("content"),
    )
    claude = F.to_json(
        F.struct(
            F.lit("bedrock-2023-05-31").alias("anthropic_version"),
            F.lit(4096).alias("max_tokens"),
            F.array(user_turn).alias("messages"),
        )
    )
    anthropic_other = F.to_json(
        F.struct(
            anthropic_prompt(prompt, rubric, code).alias("prompt"),
            F.lit(4000).alias("max_tokens_to_sample"),
            temperature.alias("temperature"),
        )
    )
    meta = F.to_json(
        F.struct(
            meta_prompt(prompt, rubric, code).alias("prompt"),
            F.lit(1536).alias("max_gen_len"),
            temperature.alias("temperature"),
        )
    )
    openai = F.to_json(
        F.struct(
            model.alias("model"),
            temperature.alias("temperature"),
            chat_messages(prompt, rubric, code, examples).alias("messages"),
            num_responses.alias("n"),
        )
    )
    kind = provider(model)
    return (
        F.when(kind == "openai", openai)
        .when(kind == "meta", meta)
        .when((kind == "anthropic") & model.contains("claude"), claude)
        .when(kind == "anthropic", anthropic_other)
    )


def option_or_param(option: Column, param: Column) -> Column:
    """A run option wins unless it is missing, zero or empty; text is compared as text."""
    shown = F.trim(option.cast("string"))
    unset = shown.isNull() | (shown == "") | F.coalesce(shown.try_cast("double") == 0, F.lit(False))
    return F.when(unset, param).otherwise(option)
