"""Messages, coordinates and ids as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the message format.
COORDINATE = r"(?i)food at \[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]"
STRICT = r"^food at \[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]$"
MESSAGE_LIMIT, MEMORY_LIMIT = 160, 240


def coordinate(message: Column) -> Column:
    """Struct (x, y) of the first coordinate named, in any case; null without one."""
    x, y = (F.regexp_extract(message, COORDINATE, i).try_cast("int") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def strict_coordinate(message: Column) -> Column:
    """Struct (x, y) if the whole message is one lower-case coordinate."""
    x, y = (F.regexp_extract(message, STRICT, i).try_cast("int") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def corrupt(message: Column, width: int, height: int) -> Column:
    """The message with its first coordinate moved by half the grid; marked where it names none."""
    at = coordinate(message)
    x = F.pmod(at["x"] + max(1, width // 2), F.lit(width))
    y = F.pmod(at["y"] + max(1, height // 2), F.lit(height))
    found = F.regexp_extract(message, COORDINATE, 0)
    place = F.instr(message, found)
    before, after = F.substring(message, F.lit(1), place - 1), F.substring(message, place + F.length(found), F.length(message))
    changed = F.concat(before, F.lit("food at ["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"), after)
    return F.when(at.isNull(), F.concat(F.lit("corrupted: "), message)).otherwise(changed)


def wrong_cell(x: Column, y: Column, width: int, height: int) -> Column:
    """A cell that is surely another: each coordinate moved by half the grid, two at least."""
    return F.struct(F.pmod(x + max(2, width // 2), F.lit(width)).alias("x"), F.pmod(y + max(2, height // 2), F.lit(height)).alias("y"))


def normal_message(message: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """Without white space at both ends, cut to the limit; null if nothing is left."""
    trimmed = F.regexp_replace(message, r"^\s+|\s+$", "")
    return F.when(trimmed != "", F.substring(trimmed, 1, limit))


def memory_item(message: Column) -> Column:
    return F.substring(message, 1, MEMORY_LIMIT)


def padded(prefix: str, number: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"))


def modular(number: Column, factor: int, shift: int = 0, modulus: int = 10_000_000) -> Column:
    return F.pmod(number * factor + shift, F.lit(modulus))


def scene_age(seed: Column, tick: Column) -> Column:
    """An age that follows from the seed and never exceeds the tick."""
    return F.pmod(seed * 17 + 11, tick + 1)


def _sole(text: Column, also) -> Column:
    """Whether a text is one JSON value, for which ``also`` holds, and nothing else; null text is not.

    The text is read as the first item of a list that a seal closes, so what follows the value is found out.
    """
    seal = F.md5(text)
    listed = F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))
    items = F.from_json(listed, "array<string>", {"allowSingleQuotes": "false"})
    held = F.transform(F.array(items), lambda x: (F.size(x) == 2) & (F.get(x, F.lit(1)) == seal))
    return F.coalesce(F.get(held, F.lit(0)) & F.json_array_length(listed).isNotNull() & also, F.lit(False))


def is_json(text: Column) -> Column:
    return _sole(text, F.lit(True))


def is_object(text: Column) -> Column:
    return _sole(text, F.btrim(text, F.lit(" \t\r\n")).startswith("{"))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, other characters as they are; null where the text is none.

    Native JSON functions keep no difference between 1.0 and 1, so this is an Arrow-batched UDF.
    """

    def rewritten(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(rewritten)
