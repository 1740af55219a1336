"""Scalar expressions of the ledger engine; all stay in the JVM except the key hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_name(topic: str = "topic", partition: str = "partition_id") -> Column:
    return F.concat_ws("-", F.col(topic), F.col(partition).cast("string"))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before a batch is repeated: 50 doubled with each attempt, 5,000 at most; attempts count from 1."""
    steps = F.least(attempt - 1, F.lit(20)).cast("int")
    return F.least(F.lit(50).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), steps), F.lit(5_000).cast("long"))


def restart_delay(restart: Column) -> Column:
    """Milliseconds before the n-th of rapid restarts (from 1): 100 doubled each time, capped at 30,000; after the cap the ramp begins anew."""
    step = F.pmod(restart - 1, F.lit(10)).cast("int")
    return F.least(F.lit(100).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), step), F.lit(30_000).cast("long"))


#: Words of an error message that tell of a lost connection.
CONNECTION_WORDS = ("connection", "network", "socket", "refused", "timeout", "closed", "broken pipe", "reset by peer")


def error_class(sqlstate: Column, message: Column) -> Column:
    """``transient`` for connection and rollback states or a message that tells of a lost connection, else ``single_item``."""
    told = F.lit(False)
    low = F.lower(F.coalesce(message, F.lit("")))
    for word in CONNECTION_WORDS:
        told = told | low.contains(word)
    state = F.coalesce(sqlstate, F.lit(""))
    return F.when(state.startswith("08") | state.startswith("40") | told, "transient").otherwise("single_item")


def base_error_class(integrity_violation: Column) -> Column:
    """The stricter rule of the base store: a violated constraint is the record's fault, anything else stops the writer."""
    return F.when(integrity_violation, "single_item").otherwise("unrecoverable")


def murmur2(keys: list[bytes]) -> np.ndarray:
    """The 32-bit key hash that partitioners of the log use, for many keys at once by length."""
    out = np.zeros(len(keys), np.int64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    m, mask = np.uint64(0x5BD1E995), np.uint64(0xFFFFFFFF)
    for length, at in by_length.items():
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), length).astype(np.uint64) if length else np.zeros((len(at), 0), np.uint64)
        h = np.full(len(at), (0x9747B28C ^ length) & 0xFFFFFFFF, np.uint64)
        whole = length // 4 * 4
        for a in range(0, whole, 4):
            k = data[:, a] | data[:, a + 1] << np.uint64(8) | data[:, a + 2] << np.uint64(16) | data[:, a + 3] << np.uint64(24)
            k = k * m & mask
            k = (k ^ k >> np.uint64(24)) * m & mask
            h = (h * m & mask) ^ k
        rest = length - whole
        if rest:
            for j in range(rest - 1, -1, -1):
                h = h ^ data[:, whole + j] << np.uint64(8 * j)
            h = h * m & mask
        h = (h ^ h >> np.uint64(13)) * m & mask
        h = h ^ h >> np.uint64(15)
        out[at] = h.astype(np.int64)
    return out


def partition_of(key: Column, partitions: int) -> Column:
    """The log partition of a text key: its murmur2 hash, as a signed number, modulo the partitions, never negative."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        h = murmur2([k.encode() for k in keys.fillna("")])
        signed = np.where(h >= 2**31, h - 2**32, h)
        return pd.Series(np.where(keys.isna(), -1, np.mod(signed, partitions)).astype(np.int32))

    return F.nullif(run(key), F.lit(-1))
