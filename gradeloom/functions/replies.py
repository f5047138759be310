"""Tool calls in models' replies, also in replies that are almost JSON; column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import text as T

CALL = "array<struct<id:string,name:string,arguments:string>>"
# Tools whose code may be recovered from a broken reply; keys that alone stand for a call, with its tool; keys of a reply that calls nothing.
CODE_TOOLS = ["submit_final_code", "validate_candidate_code"]
LONE_KEYS = {"window": "get_task_context", "code": "submit_final_code"}
NO_CALL_KEYS = ["final_code", "content", "tool_calls"]
#: What follows the end of the code in a call: the brackets of call and list, and what may come after them.
AFTER_CODE = r'\s*(?:$|\}\s*(?:\}\s*)?\]\s*(?:,\s*"content"\s*:|\}))'


def _calls(payload: Column, tools: list[str]) -> Column:
    """Calls of a reply that is a JSON object."""
    keys = F.json_object_keys(payload)
    of = lambda x, k: F.get_json_object(x, f"$.{k}")
    listed = of(payload, "tool_calls")
    given = F.when(F.startswith(listed, F.lit("[")), F.from_json(listed, "array<string>"))
    named = F.coalesce(of(payload, "name"), F.lit("")) != ""
    raw = F.when(given.isNull() & named, F.array(payload)).otherwise(F.coalesce(given, F.array().cast("array<string>")))
    lone = F.lit(None).cast(CALL)
    for key, tool in LONE_KEYS.items():
        if tool in tools:
            one = F.struct(F.lit("local_call_1").alias("id"), F.lit(tool).alias("name"), payload.alias("arguments"))
            lone = F.when((F.size(keys) == 1) & F.array_contains(keys, key), F.array(one).cast(CALL)).otherwise(lone)

    def call(item: Column, at: Column) -> Column:
        arguments = F.coalesce(of(item, "arguments"), of(item, "function.arguments"))
        whole = F.from_json(item, "map<string,variant>")
        text = F.schema_of_variant(F.coalesce(F.try_element_at(whole, F.lit("arguments")), F.try_variant_get(F.try_element_at(whole, F.lit("function")), "$.arguments", "variant"))) == "STRING"
        ident = F.coalesce(F.nullif(of(item, "id"), F.lit("")), F.concat(F.lit("local_call_"), (at + 1).cast("string")))
        kept = F.when(text | F.startswith(arguments, F.lit("{")), arguments).otherwise(F.lit("{}"))
        return F.struct(ident.alias("id"), F.coalesce(F.nullif(of(item, "name"), F.lit("")), of(item, "function.name"), F.lit("")).alias("name"), F.coalesce(kept, F.lit("{}")).alias("arguments"))

    made = F.filter(F.transform(raw, call), lambda c: c["name"] != "").cast(CALL)
    silent = F.arrays_overlap(keys, F.array(*map(F.lit, NO_CALL_KEYS)))
    return F.when((F.size(raw) == 0) & ~silent, F.coalesce(lone, made)).otherwise(made)


def _recovered(reply: Column, tools: list[str]) -> Column:
    """The call of a broken reply: a tool that takes code, and the code up to the quote that ends it."""
    name = F.regexp_extract(reply, rf'"name"\s*:\s*"({"|".join(CODE_TOOLS)})"', 1)
    ended = F.regexp_extract(reply, rf'(?s)"code"\s*:\s*"(.*?(?<!\\)(?:\\\\)*)"(?={AFTER_CODE})', 1)
    open_ = F.regexp_extract(reply, r'(?s)"code"\s*:\s*"(.*)$', 1)
    code = F.coalesce(F.nullif(ended, F.lit("")), open_)
    for mark, put in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        code = F.replace(code, F.lit(mark), F.lit(put))
    found = F.contains(reply, F.lit("tool_calls")) & reply.rlike(r'"code"\s*:\s*"') & name.isin(*(t for t in CODE_TOOLS if not tools or t in tools))
    one = F.struct(F.lit("local_call_1").alias("id"), name.alias("name"), F.to_json(F.struct(T.strip(code).alias("code"))).alias("arguments"))
    return F.when(found, F.array(one)).otherwise(F.array()).cast(CALL)


def tool_calls(reply: Column, tools: list[str]) -> Column:
    """Calls (id, name, arguments as JSON text) of replies, each an object or list in JSON; ``tools``: names that may be inferred or recovered. Other texts call nothing, nor does null.

    Calls stand in ``tool_calls``, or the reply is one itself, or its only key is one that stands for a call. A reply that isn't JSON, most often as code in it has quotes and line ends of its own, gives the call that can
    be recovered."""
    text = T.strip(F.coalesce(reply, F.lit("")))
    is_json = F.try_parse_json(text).isNotNull()
    out = F.when(is_json & F.startswith(text, F.lit("{")), _calls(text, tools)).when(~is_json & text.rlike(r"^[\[{]"), _recovered(text, tools))
    return F.coalesce(out, F.array().cast(CALL))
