"""JSON of providers read by the type of each value: replies, errors, and values as Python writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import strip_reasoning

# What providers call the end of a reply.
TRUNCATED = {"chat": ["length", "max_tokens", "model_length"], "anthropic": ["max_tokens"], "gemini": ["MAX_TOKENS"]}
REFUSED = {"chat": ["content_filter", "safety", "sensitive", "refusal"], "anthropic": ["refusal"], "gemini": ["SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "IMAGE_SAFETY"]}


def kind_of(value: Column) -> Column:
    """What a variant is: null, VOID, BOOLEAN, STRING, BIGINT, DECIMAL(...), DOUBLE, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(value)


def at(value: Column, path: str) -> Column:
    """The variant at a path, null where there is none."""
    return F.try_variant_get(value, path, "variant")


def string_at(value: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is of another type."""
    found = at(value, path)
    return F.when(kind_of(found) == "STRING", F.try_variant_get(value, path, "string"))


def items_at(value: Column, path: str) -> Column:
    """The items of the list at a path; none if there is no list."""
    return F.coalesce(F.when(kind_of(at(value, path)).startswith("ARRAY"), F.try_variant_get(value, path, "array<variant>")), F.array().cast("array<variant>"))


def number_at(value: Column, path: str) -> Column:
    found = at(value, path)
    return F.when(kind_of(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, path, "double"))


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def _joined(items: Column, said) -> Column:
    return F.array_join(F.transform(items, lambda part: F.coalesce(said(part), F.lit(""))), "")


def _thought(part: Column) -> Column:
    return F.coalesce(F.try_variant_get(part, "$.thought", "boolean") & (kind_of(at(part, "$.thought")) == "BOOLEAN"), F.lit(False))


def chat_reply(dialect: Column, body: Column) -> Column:
    """text, finish ("complete", "truncated" or "refused"), input, output and error of a provider's JSON reply.

    dialect is "openai", "azure", "anthropic" or "gemini"; the first two speak alike. Parts of a text are joined; thoughts and what isn't text
    are left out, and so is a block of reasoning before it. input and output are tokens, both or neither. A reply whose "error" is an object has
    its message as error and nothing else. A text that is no JSON, or no object, is an empty reply, as a provider's empty object is.
    """
    root = F.try_parse_json(body)
    failed = at(root, "$.error")
    error = F.when(is_object(failed), F.coalesce(string_at(root, "$.error.message"), F.get_json_object(body, "$.error")))
    kind = F.when(dialect.isin("anthropic", "gemini"), dialect).otherwise("chat")

    content = "$.choices[0].message.content"
    part = lambda p: F.when((string_at(p, "$.type") == "text") | ~_thought(p), string_at(p, "$.text"))
    chat = F.coalesce(string_at(root, content), _joined(items_at(root, content), part))
    blocks = _joined(items_at(root, "$.content"), lambda p: F.when(string_at(p, "$.type") == "text", string_at(p, "$.text")))
    parts = _joined(items_at(root, "$.candidates[0].content.parts"), lambda p: F.when(~_thought(p), string_at(p, "$.text")))
    feedback = at(root, "$.promptFeedback.blockReason")
    # what JavaScript takes for true: all but null, false, zero and the empty string
    blocked = (kind == "gemini") & F.coalesce(~kind_of(feedback).isin("VOID") & ~F.coalesce(F.try_variant_get(root, "$.promptFeedback.blockReason", "string").isin("", "false", "0"), F.lit(False)), F.lit(False))
    text = F.when(blocked, "").when(kind == "chat", chat).when(kind == "anthropic", blocks).otherwise(parts)

    reason = F.when(kind == "chat", string_at(root, "$.choices[0].finish_reason")).when(kind == "anthropic", string_at(root, "$.stop_reason")).otherwise(string_at(root, "$.candidates[0].finishReason"))
    one_of = lambda names: F.coalesce(F.reduce(F.array(*[(kind == k) & reason.isin(*v) for k, v in names.items()]), F.lit(False), lambda x, y: x | F.coalesce(y, F.lit(False))), F.lit(False))
    declined = (kind == "chat") & (text == "") & (F.coalesce(string_at(root, "$.choices[0].message.refusal"), F.lit("")) != "")
    finish = F.when(blocked, "refused").when(one_of(TRUNCATED), "truncated").when(one_of(REFUSED) | declined, "refused").otherwise("complete")

    names = {"chat": ("$.usage.prompt_tokens", "$.usage.completion_tokens"), "anthropic": ("$.usage.input_tokens", "$.usage.output_tokens"), "gemini": ("$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount")}
    used = [F.coalesce(*[F.when(kind == k, number_at(root, paths[i])) for k, paths in names.items()]) for i in (0, 1)]
    both = used[0].isNotNull() & used[1].isNotNull() & ~blocked
    good = error.isNull()
    return F.struct(
        F.when(good, strip_reasoning(text)).alias("text"), F.when(good, finish).alias("finish"), F.when(good & both, used[0].cast("long")).alias("input"), F.when(good & both, used[1].cast("long")).alias("output"), error.alias("error")
    )


def python_str(json: Column) -> Column:
    """A JSON value, given as text, as Python's str() writes it: strings bare, None, True and False, numbers and compact JSON.

    Numbers have no ".0" and no zeros at the end of a fraction. null for what is no JSON.
    """
    value = F.try_parse_json(json)
    kind = kind_of(value)
    bare = F.trim(json)
    number = F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(bare))
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.get_json_object(json, "$"))
        .when(kind.isNotNull(), F.when(bare.rlike("[eE]"), F.try_variant_get(value, "$", "string")).when(bare == "-0", "0").otherwise(number))
    )
