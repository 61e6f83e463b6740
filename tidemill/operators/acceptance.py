"""Whole-group acceptance: groups are taken in order, and one that shares a fingerprint with any taken before is rejected whole.

Taken one by one this is a loop over all groups.  Here it is the first independent set by order, in
rounds: a group that comes first at all its fingerprints cannot be rejected, so all such groups are
accepted at once; groups that share a fingerprint with them are rejected; the rest goes on.  A round is
two aggregations and two joins, and a fingerprint that very many groups hold ends with the first of its
groups to be accepted.  Where orders are as good as random, rounds grow with the logarithm of the
groups; a chain in which each group only conflicts with the next takes a round for each two, so once
what is left fits a task (``finish_rows``, a bound on rows whatever the input) it is settled there in
order.

Defined results: a group with a known fingerprint is rejected; repeats within a group don't matter; null
fingerprints meet nothing; a group without fingerprints is accepted; ties of the order are settled by
the group's own name, and a group listed with several orders counts by the least; null groups are left
out; an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.skew import lookup
from tidemill.sources.staging import drop, staged

FINISH_ROWS = 200_000


def _in_order(batches, schema: pa.Schema):
    """Settle groups one by one; rows come in the groups' order, all of a group together."""
    taken, group, held = set(), None, []
    names, verdicts = [], []

    def settle():
        ok = taken.isdisjoint(held)
        if ok:
            taken.update(held)
        names.append(group)
        verdicts.append(ok)

    for b in batches:
        for g, fp in zip(b.column("_group").to_pylist(), b.column("_fp").to_pylist(), strict=True):
            if g != group:
                if group is not None:
                    settle()
                group, held = g, []
            held.append(fp)
    if group is not None:
        settle()
    yield pa.RecordBatch.from_arrays([pa.array(names, schema.field("_group").type), pa.array(verdicts, pa.bool_())], names=["_group", "accepted"])


def accept_groups(rows: DataFrame, group: str, fingerprint: str, order: str, known: DataFrame | None = None, limit: int | None = None, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """``group`` and ``accepted`` for every group of (group, fingerprint, order) rows.

    ``known`` has a column ``fingerprint`` of what was accepted before all of them.  With a limit, only
    the first so many accepted groups stay accepted.
    """
    base = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_group"), F.col(fingerprint).alias("_fp"), F.col(order).alias("_order"))
    groups = staged(base.groupBy("_group").agg(F.min("_order").alias("_order"), F.count_distinct("_fp").alias("_n")), "groups")
    left = staged(base.where("_fp is not null").select("_group", "_fp").distinct().join(groups.select("_group", "_order", "_n"), "_group"), "conflicts")
    settled = [groups.where("_n = 0").select("_group", F.lit(True).alias("accepted"))]

    def without(now: DataFrame, gone: DataFrame) -> DataFrame:
        out = staged(now.join(gone.select("_group"), "_group", "left_anti"), "conflicts")
        drop(now)
        return out

    if known is not None:
        seen = staged(lookup(left.select("_group", "_fp"), known.select(F.col(fingerprint).alias("_fp")).distinct(), ["_fp"], "left_semi").select("_group").distinct(), "rejected")
        settled.append(seen.select("_group", F.lit(False).alias("accepted")))
        left = without(left, seen)
    while (n := left.count()) > finish_rows:
        first = left.groupBy("_fp").agg(F.min(F.struct("_order", "_group", "_n")).alias("f"))
        taken = staged(first.groupBy("f._group", "f._n").agg(F.count("*").alias("wins")).where("wins = _n").select("_group"), "accepted")
        theirs = left.join(taken, "_group", "left_semi").select("_fp")  # each belongs to one group
        out = staged(lookup(left.select("_group", "_fp"), theirs, ["_fp"], "left_semi").select("_group").distinct().join(taken, "_group", "left_anti"), "rejected")
        settled += [taken.select("_group", F.lit(True).alias("accepted")), out.select("_group", F.lit(False).alias("accepted"))]
        left = without(left, taken.union(out))
    if n:
        kind = T.StructType([left.schema["_group"]]).add("accepted", "boolean")
        last = left.select("_group", "_fp", "_order").coalesce(1).sortWithinPartitions("_order", "_group").select("_group", "_fp")  # at most finish_rows rows
        arrow = pa.schema([("_group", _arrow_type(left.schema["_group"].dataType))])
        settled.append(last.mapInArrow(lambda b: _in_order(b, arrow), kind))
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    if limit is not None:
        done = staged(done, "settled")
        kept = done.where("accepted").join(groups.select("_group", "_order"), "_group").orderBy("_order", "_group").limit(limit).select("_group", F.lit(True).alias("_kept"))
        done = done.join(kept, "_group", "left").select("_group", F.coalesce("_kept", F.lit(False)).alias("accepted"))
    return done.select(F.col("_group").alias(group), "accepted")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def accepted_records(records: DataFrame, group: str, fingerprint: str, order: str, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The records of accepted groups; null groups have none."""
    chosen = accept_groups(records, group, fingerprint, order, known, limit).where("accepted").select(group)
    return records.join(chosen, group, "left_semi")
