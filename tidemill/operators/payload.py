"""Event payloads as VARIANT: one parse a row, typed fields by path, shredded files.

A payload is JSON text, or a VARIANT column that was written from it.  Fields are read by path with a
type; what is missing, of another shape or out of range is null.  Over text, all fields come from one
parse: it is bound inside a generator, behind which no filter or projection can be moved that would
parse again.  Over a VARIANT column in Parquet, the fields go to the scan, which reads only their
shredded columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the event log that are no payload.
ENVELOPE = ["seed", "condition", "seq", "tick", "kind", "actor_id"]


def field(payload: Column, path: str, kind: str) -> Column:
    """A field by path; objects and lists asked for as strings come as compact JSON with sorted keys and shortest numbers (1.0 as 1)."""
    return F.try_variant_get(payload, f"$.{path}", kind)


def decoded(events: DataFrame, fields: dict[str, tuple[str, str]], payload: str = "data") -> DataFrame:
    """The events without their payload, with a column for each field: name -> (path, type).

    Names must differ from the events' own.  A text that is no JSON, or repeats a key, has no fields.
    """
    own = [F.col(c) for c in events.columns if c != payload]
    if isinstance(events.schema[payload].dataType, T.VariantType):
        return events.select(*own, *[field(F.col(payload), *f).alias(name) for name, f in fields.items()])
    parsed = F.array(F.try_parse_json(F.col(payload)))
    return events.select(*own, F.inline(F.transform(parsed, lambda v: F.struct(*[field(v, *f).alias(name) for name, f in fields.items()]))))


def shredded(events: DataFrame, payload: str = "data") -> DataFrame:
    """The events with their payload as VARIANT, which Parquet writers split into typed columns; broken payloads become null."""
    return events.withColumn(payload, F.try_parse_json(F.col(payload)))
