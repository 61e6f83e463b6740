"""Actions: parsing, canonical text and legality.

Strict parsing is a column expression.  It takes what Python's ``json`` takes (``strict`` is that rule in
plain Python): a text that is one value and nothing else, the last of repeated keys, booleans that are
no integers.  Lenient parsing looks for JSON inside any text, which no native parser does, so it is an
Arrow-batched UDF.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the protocol.
KINDS = ("move", "forage", "share", "signal", "rest", "reproduce")
MESSAGE_LIMIT = 160
NO_THRESHOLD = 10**9

ACTION = T.StructType().add("action", "string").add("x", "integer").add("y", "integer").add("target", "string").add("amount", "integer").add("message", "string")
_EMPTY = dict.fromkeys(ACTION.names)


def _whole(value) -> bool:
    return type(value) is int and -(2**31) <= value < 2**31


def checked(payload) -> dict | None:
    """Flat action of a JSON value; none if it breaks the protocol.  Extra keys don't matter."""
    if not isinstance(payload, dict) or payload.get("action") not in KINDS:
        return None
    kind, target = payload["action"], payload.get("target")
    made = {**_EMPTY, "action": kind}
    if kind in ("move", "reproduce"):
        ok = isinstance(target, list) and len(target) == 2 and all(map(_whole, target))
        return {**made, "x": target[0], "y": target[1]} if ok else None
    if kind == "share":
        ok = isinstance(target, str) and target and _whole(payload.get("amount")) and payload["amount"] >= 1
        return {**made, "target": target, "amount": payload["amount"]} if ok else None
    if kind == "signal":
        message = payload.get("message")
        ok = isinstance(message, str) and message.strip()
        return {**made, "message": message.strip()[:MESSAGE_LIMIT]} if ok else None
    return made


def strict(text) -> dict | None:
    """Action of a text that is one JSON object and nothing else."""
    try:
        return checked(json.loads(text))
    except (TypeError, ValueError, RecursionError):
        return None


def unfenced(text: str) -> str:
    lines = text.strip().splitlines()
    if lines and lines[0].startswith("```"):
        lines = lines[1:]
        if lines and lines[-1].strip() == "```":
            lines.pop()
        return "\n".join(lines).strip()
    return text.strip()


def lenient(text) -> dict | None:
    """Action of the first JSON object that can be read anywhere in a text."""
    if not isinstance(text, str):
        return None
    body, reader = unfenced(text), json.JSONDecoder()
    at = body.find("{")
    while at >= 0:
        try:
            return checked(reader.raw_decode(body, at)[0])
        except (ValueError, RecursionError):
            at = body.find("{", at + 1)
    return None


@F.pandas_udf(ACTION)
def _lenient(texts: pd.Series) -> pd.DataFrame:
    found = [lenient(t) or _EMPTY for t in texts]
    return pd.DataFrame(found, columns=ACTION.names).astype({"x": "Int32", "y": "Int32", "amount": "Int32"})


#: What Python strips as white space: the characters for which ``str.isspace`` holds.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Fields of an action, each as it stands; of repeated keys the last counts, other keys are passed over.
_FIELDS = "array<struct<action variant, target variant, amount variant, message variant>>"


def _judged(read: Column) -> Column:
    """The action of ``p``, which must hold one object and then the seal."""
    found = F.get(read["p"], F.lit(0))
    whole = (F.size(read["p"]) == 2) & (F.try_variant_get(F.get(read["p"], F.lit(1))["action"], "$", "string") == read["seal"])
    kind = F.when(F.coalesce(whole, F.lit(False)), F.try_variant_get(found["action"], "$", "string"))
    shape = lambda name: F.coalesce(F.schema_of_variant(found[name]), F.lit("none"))
    cell, place = F.try_variant_get(found["target"], "$", "array<int>"), kind.isin("move", "reproduce")
    at = lambda i: F.when(place, F.get(cell, F.lit(i)))
    name, amount = F.try_variant_get(found["target"], "$", "string"), F.try_variant_get(found["amount"], "$", "int")
    said = F.btrim(F.try_variant_get(found["message"], "$", "string"), F.lit(SPACES))
    ok = (
        F.when(place, (shape("target") == "ARRAY<BIGINT>") & (F.size(cell) == 2) & at(0).isNotNull() & at(1).isNotNull())
        .when(kind == "share", (shape("target") == "STRING") & (name != "") & (shape("amount") == "BIGINT") & (amount >= 1))
        .when(kind == "signal", (shape("message") == "STRING") & (said != ""))
        .otherwise(kind.isin("forage", "rest"))
    )
    made = F.struct(
        kind.alias("action"), at(0).alias("x"), at(1).alias("y"), F.when(kind == "share", name).alias("target"),
        F.when(kind == "share", amount).alias("amount"), F.when(kind == "signal", F.substring(said, 1, MESSAGE_LIMIT)).alias("message"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.lit(None).cast(ACTION))


def parse_strict(text: Column) -> Column:
    """Struct of an action; its field ``action`` is null where the text is not one.

    The text is read as the first item of a list that ends in a seal, a hash of the text itself, so a
    text that holds more than one value, or closes the list, is found out.  Spark's reader keeps what it
    could read of a broken value, so the list must also be well-formed as a whole: its length must be
    known, or, where it holds a number that only Python writes (NaN, Infinity), its record not be corrupt.
    """
    strictly = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken"}
    seal = F.md5(text)
    listed = F.concat(F.lit("["), text, F.lit(',{"action":"'), seal, F.lit('"}]'))
    odd = F.from_json(F.concat(F.lit('{"v":'), listed, F.lit("}")), f"struct<v: {_FIELDS}, broken: string>", strictly)
    fine = F.when(F.json_array_length(listed).isNotNull(), True).when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), odd["v"].isNotNull() & odd["broken"].isNull())
    read = F.struct(F.when(fine, F.from_json(listed, _FIELDS, strictly)).alias("p"), seal.alias("seal"))
    return F.get(F.transform(F.array(read), _judged), F.lit(0))


def parse_lenient(text: Column) -> Column:
    return _lenient(text)


def action_json(action: Column) -> Column:
    """Compact JSON with sorted keys; only what the kind carries."""
    cell = F.when(action["x"].isNotNull(), F.concat(F.lit("["), action["x"].cast("string"), F.lit(","), action["y"].cast("string"), F.lit("]")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    target = F.coalesce(cell, F.when(action["target"].isNotNull(), quoted(action["target"])))
    parts = F.array(
        F.concat(F.lit('"action":"'), action["action"], F.lit('"')),
        F.when(action["amount"].isNotNull(), F.concat(F.lit('"amount":'), action["amount"].cast("string"))),
        F.when(action["message"].isNotNull(), F.concat(F.lit('"message":'), quoted(action["message"]))),
        F.when(target.isNotNull(), F.concat(F.lit('"target":'), target)),
    )
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ","), F.lit("}"))


def legality(action: Column, energy: Column, threshold: Column, current_food: Column, open_cells: Column, agents: Column) -> Column:
    """Struct (legal, reason) of an action under an observation; what is missing takes its default."""
    target = F.struct(action["x"].alias("x"), action["y"].alias("y"))
    open_ = F.coalesce(F.exists(open_cells, lambda c: (c["x"] == target["x"]) & (c["y"] == target["y"])), F.lit(False))
    near = F.coalesce(F.exists(agents, lambda a: (a["id"] == action["target"]) & (a["distance"] == 1)), F.lit(False))
    strength = F.coalesce(energy, F.lit(0))
    reason = (
        F.when((action["action"] == "forage") & ~(F.coalesce(current_food, F.lit(0)) > 0), "no food")
        .when(action["action"].isin("move", "reproduce") & ~open_, "target not open")
        .when((action["action"] == "reproduce") & (strength < F.coalesce(threshold, F.lit(NO_THRESHOLD))), "below reproduction threshold")
        .when((action["action"] == "share") & ~near, "target not adjacent")
        .when((action["action"] == "share") & (strength <= F.coalesce(action["amount"], F.lit(0))), "insufficient energy")
        .otherwise("legal")
    )
    return F.struct((reason == "legal").alias("legal"), reason.alias("reason"))


def safe_share(energy: Column, threshold: Column, target: Column, agents: Column, need: int = 3) -> Column:
    """Donor at or above its threshold, target adjacent and needy."""
    needy = F.exists(agents, lambda a: (a["id"] == target) & (a["distance"] == 1) & (a["energy"] <= need))
    return (energy >= F.coalesce(threshold, F.lit(NO_THRESHOLD))) & F.coalesce(needy, F.lit(False))


def local_rule(current_food: Column, nearest_visible: Column, remembered: Column, open_cells: Column, curiosity: Column, energy: Column) -> Column:
    """The rule label of an observation: forage, then towards seen or remembered food, then explore, then rest."""
    can_move = F.size(open_cells) > 0
    return (
        F.when(current_food > 0, "forage")
        .when(nearest_visible.isNotNull() & can_move, "approach_visible")
        .when(remembered.isNotNull() & can_move, "approach_remembered")
        .when((curiosity >= 0.5) & (energy > 7) & can_move, "explore")
        .otherwise("rest")
    )


def scripted(start: Column, gains: Column, metabolism: int = 1) -> Column:
    """State (energy, age, tick) after a script's turns, each with its gain of energy; no turn follows a death."""
    turn = lambda s, gain: F.struct((s["energy"] + gain - metabolism).alias("energy"), (s["age"] + 1).alias("age"), (s["tick"] + 1).alias("tick"))
    return F.aggregate(gains, start, lambda s, gain: F.when(s["energy"] > 0, turn(s, gain)).otherwise(s))
