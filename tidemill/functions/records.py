"""Prompt and completion records: construction, extraction and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.actions import action_json, parse_strict
from tidemill.functions.text import canonical_json, is_json, is_object


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_record(df: DataFrame, system: Column, user: Column, answer: Column) -> DataFrame:
    """The prompt (system, user) and the completion (assistant) beside what the row holds."""
    return df.withColumns({"prompt": F.array(message("system", system), message("user", user)), "completion": F.array(message("assistant", answer))})


def last_user(prompt: Column) -> Column:
    return F.element_at(F.filter(prompt, lambda m: m["role"] == "user"), -1)["content"]


def first_object_user(prompt: Column, required: bool = False) -> Column:
    """The first user message that is a JSON object, found by parsing; messages of another JSON type are passed over.

    Null without one, and broken messages are passed over too; if ``required``, both are errors.
    """
    users = F.transform(F.filter(prompt, lambda m: m["role"] == "user"), lambda m: m["content"])
    if not required:
        return F.get(F.filter(users, is_object), F.lit(0))
    kinds = F.transform(users, lambda c: F.when(is_object(c), "object").when(is_json(c), "other").otherwise("broken"))
    at = F.array_position(kinds, "object")
    broken = F.array_position(kinds, "broken")
    none = F.when((broken > 0) & ((at == 0) | (broken < at)), "a user message is not JSON").otherwise("no object-valued user message")
    return F.when((at > 0) & ((broken == 0) | (at < broken)), F.get(users, (at - 1).cast("int"))).otherwise(F.raise_error(none).cast("string"))


def rebuilt(records: DataFrame, system: Column) -> DataFrame:
    """Records made anew from what they hold: the system message, the observation and the action in canonical form, all other columns kept.

    The observation is the first object-valued user message; a record without one, or without an action, is an error.
    """
    action = parse_strict(F.get("completion", F.lit(0))["content"])
    held = records.withColumns({"_observation": first_object_user(F.col("prompt"), required=True), "_action": action})
    answer = F.when(F.col("_action.action").isNotNull(), action_json(F.col("_action"))).otherwise(F.raise_error(F.lit("a completion has no action")).cast("string"))
    return chat_record(held, system, canonical_json(F.col("_observation")), answer).drop("_observation", "_action")


def with_system(prompt: Column, system: Column) -> Column:
    """The prompt under another system message; an error where it does not start with one."""
    ok = F.get(prompt, F.lit(0))["role"] == "system"
    changed = F.transform(prompt, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, system).otherwise(m["content"]).alias("content")))
    return F.when(F.coalesce(ok, F.lit(False)), changed).otherwise(F.raise_error(F.lit("prompt does not start with a system message")).cast("array<struct<role:string,content:string>>"))


def inject_last_user(prompt: Column, change) -> Column:
    """The prompt with ``change`` applied to its last user message; an error where it has none."""
    place = F.size(prompt) - F.array_position(F.transform(F.reverse(prompt), lambda m: m["role"]), "user").cast("int")
    changed = F.transform(prompt, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == place, change(m["content"])).otherwise(m["content"]).alias("content")))
    return F.when(F.exists(prompt, lambda m: m["role"] == "user"), changed).otherwise(F.raise_error(F.lit("prompt has no user message")).cast("array<struct<role:string,content:string>>"))


def action_kind(completion: Column) -> Column:
    """Unchecked action of the first completion message."""
    return F.get_json_object(F.get(completion, F.lit(0))["content"], "$.action")


def fp_record(*columns: Column) -> Column:
    """Fingerprint of all given columns, keys in alphabetical order as given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def fp_prompt_completion(prompt: Column, completion: Column) -> Column:
    return F.sha2(F.to_json(F.struct(completion.alias("completion"), prompt.alias("prompt"))), 256)


def fp_semantic(observation: Column, completion: Column) -> Column:
    """Fingerprint of observation and completion, whatever the system message says."""
    return F.sha2(F.concat_ws("\n", observation, F.to_json(completion)), 256)


def tagged(df: DataFrame, curriculum: str, **metadata: Column) -> DataFrame:
    """Metadata columns of a curriculum beside a record."""
    return df.withColumns({"curriculum": F.lit(curriculum), **metadata})


def peer_visibility(df: DataFrame, agents: Column, food: Column, target: Column, radius: Column) -> DataFrame:
    """Peers that can and cannot see the target and any food; an error where the parts do not add up."""
    near = lambda a, c: F.abs(a["x"] - c["x"]) + F.abs(a["y"] - c["y"]) <= radius
    sees = F.size(F.filter(agents, lambda a: near(a, target)))
    fed = F.size(F.filter(agents, lambda a: F.exists(food, lambda c: near(a, c))))
    n = F.size(agents)
    return df.withColumns({"peers_with_target_in_view": sees, "peers_without_target_in_view": n - sees, "peers_with_any_food_in_view": fed, "peers_without_any_food_in_view": n - fed})


def zip_strict(*lists: Column) -> Column:
    """Structs of the elements side by side; an error where lengths differ."""
    same = F.lit(True)
    for other in lists[1:]:
        same = same & (F.size(lists[0]) == F.size(other))
    zipped = F.arrays_zip(*lists)
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("lists of different lengths")))
