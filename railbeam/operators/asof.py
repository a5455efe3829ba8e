"""Records to the latest activation of their train that has not expired.

Spark has no as-of join. Records and activations are laid on one time line per train and the last
activation is carried forward by a running window. The time line of a train is cut into slices of a
fraction of the expiry, so a train that holds a large part of all records is spread over many
groups. Nothing older than the expiry counts, so a slice needs, besides its own activations, only
the last activation of each of the few slices before it; those are reduced before they are copied.
Where a slice of a train still holds very many records, they are dealt over ``salts`` groups, each of which sees
every activation of the slice. Such groups are found by a sketch of the heaviest ones, a small list of fixed length,
so that no other activation is copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbeam.constants import DEFAULT_SALTS
from railbeam.operators.firsts import last_per

#: Groups that a sketch tracks and names, and records of a group from which on it is salted.
TRACKED, HEAVIEST, HEAVY_ROWS = 20_000, 1000, 200_000
ACTIVATION_FIELDS = ["schedule_train_id", "origin_stanox_code", "origin_departure_timestamp"]


def latest_activations(activations: DataFrame, order: Sequence[str] = ("arrival_ms", "seq")) -> DataFrame:
    """The last activation of each train."""
    return last_per(activations, ["train_id"], list(order))


def heavy_groups(rows: DataFrame, key: Column, least: int) -> Column:
    """The keys with about ``least`` rows or more, among the heaviest ``HEAVIEST``, as an array known before the
    plan that uses it runs. The sketch may name a lighter one, never miss one with over a ``TRACKED``-th of all rows."""
    top = F.expr(f"transform(filter(approx_top_k(k, {HEAVIEST}, {TRACKED}), x -> x.count >= {least}), x -> x.item)")
    return rows.select(key.alias("k")).agg(top.alias("heavy")).scalar()


def _slice_of(arrival: Column, width: int) -> Column:
    return ((arrival - F.pmod(arrival, F.lit(width))) / F.lit(width)).cast("bigint")


def with_activation(
    records: DataFrame,
    activations: DataFrame,
    ttl_ms: int,
    order: Sequence[str] = ("arrival_ms", "seq"),
    slices: int = 16,
    salts: int = DEFAULT_SALTS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Inner as-of join; a record before its activation or past its expiry is dropped.

    ``order`` names the columns of the total order that both sides share; the first is the arrival
    in milliseconds. An activation is good up to and including ``ttl_ms`` after its arrival.
    """
    arrival = order[0]
    width = max(1, ttl_ms // slices)
    reach = -(-ttl_ms // width)
    if not set(ACTIVATION_FIELDS).isdisjoint(records.columns):
        raise ValueError(f"records must not have the activation columns {ACTIVATION_FIELDS}")

    marks = activations.select(
        "train_id", *order, F.struct(F.col(arrival).alias("activated_ms"), *ACTIVATION_FIELDS).alias("act")
    ).withColumn("slice", _slice_of(F.col(arrival), width))
    ahead = F.explode(F.sequence(F.col("slice") + 1, F.col("slice") + reach))
    carried = last_per(marks, ["train_id", "slice"], order).withColumn("slice", ahead)
    group = F.concat_ws("|", "train_id", F.col("slice").cast("string"))
    sliced = records.select("train_id", _slice_of(F.col(arrival), width).alias("slice"))
    is_heavy = F.coalesce(F.array_contains(heavy_groups(sliced, group, heavy_rows), group), F.lit(False)) if salts > 1 else F.lit(False)
    last_salt = F.when(is_heavy, F.lit(salts - 1)).otherwise(F.lit(0))
    marks = marks.unionByName(carried).withColumn("salt", F.explode(F.sequence(F.lit(0), last_salt)))

    payload = [c for c in records.columns if c != "train_id" and c not in order]
    rows = records.select(
        "train_id",
        *order,
        _slice_of(F.col(arrival), width).alias("slice"),
        F.struct(*payload).alias("row"),
        F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("salt", F.when(is_heavy, F.col("salt")).otherwise(F.lit(0)))
    line = rows.unionByName(marks, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("train_id", "slice", "salt")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = line.withColumn("act", F.last("act", ignorenulls=True).over(so_far)).filter(
        F.col("row").isNotNull() & (F.col(arrival) - F.col("act.activated_ms") <= ttl_ms)
    )
    return matched.select("train_id", *order, "row.*", *[f"act.{f}" for f in ACTIVATION_FIELDS]).select(
        *records.columns, *ACTIVATION_FIELDS
    )
