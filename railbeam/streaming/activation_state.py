"""Keyed state: the latest activation of each train.

Each call gets the rows of one (train, salt) in one micro-batch and works on plain arrays, one for a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railbeam.constants import (
    ACTIVATION_TTL_MS,
    DEFAULT_SALTS,
    MSG_ACTIVATION,
    MSG_CANCELLATION,
    MSG_CHANGE_OF_ORIGIN,
    MSG_MOVEMENT,
)
from railbeam.operators.asof import ACTIVATION_FIELDS

ORDER = ["arrival_ms", "seq", "pos"]
STATE = T.StructType(
    [
        T.StructField("activated_ms", T.LongType()),
        T.StructField("schedule_train_id", T.StringType()),
        T.StructField("origin_stanox_code", T.StringType()),
        T.StructField("origin_departure_timestamp", T.LongType()),
    ]
)


def activation_state(ttl_ms: int, columns: list[str]) -> StatefulProcessor:
    """The processor of one stream. It is a local class so that it travels to the workers by value."""

    class ActivationState(StatefulProcessor):
        """Puts activations, and gives every later record of the train the latest one."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("activation", STATE, ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frames = [frame for frame in rows if len(frame)]
            if not frames:
                return
            # Plain columns in the order of arrival; groups are small and many, so a frame is made once, at the end.
            given = {c: np.concatenate([frame[c].to_numpy() for frame in frames]) for c in frames[0].columns}
            order = np.lexsort([given[c] for c in reversed(ORDER)])
            batch = {c: values[order] for c, values in given.items()}
            arrival, is_put = batch["arrival_ms"], batch["msg_type"] == MSG_ACTIVATION
            # Row number of the last activation at or before each row; -1 is the held one.
            last = np.maximum.accumulate(np.where(is_put, np.arange(len(order)), -1))
            held = self.held.get() if self.held.exists() else None
            before = held if held is not None else (0, None, None, None)
            activated = np.concatenate(([before[0]], arrival))[last + 1]
            found = ~is_put & ((last >= 0) | (held is not None)) & (arrival - activated <= ttl_ms)
            if last[-1] >= 0:
                newest = {f: batch[f][last[-1]] for f in ACTIVATION_FIELDS}
                departure = int(newest["origin_departure_timestamp"])
                self.held.update((int(arrival[last[-1]]), newest["schedule_train_id"], newest["origin_stanox_code"], departure))
            if not found.any():
                return
            out = {c: values[found] for c, values in batch.items() if c in columns}
            for field, kept in zip(STATE.fieldNames()[1:], before[1:], strict=True):
                own = np.concatenate((np.array([kept], object), batch[field].astype(object)))
                out[field] = own[last[found] + 1]
            # Text, so that a column of nulls and numbers keeps whole numbers.
            out["origin_departure_timestamp"] = np.array([str(int(v)) for v in out["origin_departure_timestamp"]], object)
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return ActivationState()


def enrich_stream(records: DataFrame, ttl_ms: int = ACTIVATION_TTL_MS, salts: int = DEFAULT_SALTS) -> DataFrame:
    """Records with their train's activation; those that have none are dropped for good.

    ``records`` are exploded messages. With ``salts`` above 1 the records of one train are dealt over
    that many state groups and each group holds a copy of the activation, so that one busy train is
    not one task.
    """
    longs = [f.name for f in records.schema.fields if f.dataType == T.LongType() and f.name not in ORDER]
    routed = records.filter(
        F.col("msg_type").isin(MSG_ACTIVATION, MSG_CANCELLATION, MSG_MOVEMENT, MSG_CHANGE_OF_ORIGIN)
    )
    dealt = F.array(F.pmod(F.xxhash64(*ORDER), F.lit(salts)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(salts - 1))
    keyed = routed.withColumns({c: F.col(c).cast("string") for c in longs}).withColumn(
        "salt", F.explode(F.when(F.col("msg_type") == MSG_ACTIVATION, everywhere).otherwise(dealt))
    )
    columns = [c for c in keyed.columns if c != "salt"]
    schema = T.StructType([keyed.schema[c] for c in columns])
    enriched = keyed.groupBy("train_id", "salt").transformWithStateInPandas(
        statefulProcessor=activation_state(ttl_ms, columns),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return enriched.withColumns({c: F.col(c).cast("bigint") for c in longs})
