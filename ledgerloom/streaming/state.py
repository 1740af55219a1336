"""Keyed running state in a stream: each account's balance in the state store."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import CHANGE_SCHEMA

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["topic", "partition_id", "offset_value", "account_number", "amount", "reason", "resulting_balance"]


# Spark runs the processor in a process of the driver that has no files that were added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class BalanceProcessor(StatefulProcessor):
    """Adds up an account's amounts; rows at or below the last offset of their log partition are replays and drop out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance long")
        self.seen = handle.getMapState("seen", "topic string, partition_id int", "offset_value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # rows of one account in one micro-batch come in several frames and in any order
        frame = pd.concat(list(rows)).sort_values(["topic", "partition_id", "offset_value"]).drop_duplicates(["topic", "partition_id", "offset_value"])
        parts = []
        for (topic, partition), own in frame.groupby(["topic", "partition_id"], sort=True):
            place = (topic, int(partition))
            last = self.seen.getValue(place)[0] if self.seen.containsKey(place) else -1
            own = own[own["offset_value"] > last]
            if len(own):
                self.seen.updateValue(place, (int(own["offset_value"].iloc[-1]),))
                parts.append(own)
        if not parts:
            return
        fresh = pd.concat(parts)
        start = self.balance.get()[0] if self.balance.exists() else 0
        fresh = fresh.assign(resulting_balance=start + fresh["amount"].cumsum())
        self.balance.update((int(fresh["resulting_balance"].iloc[-1]),))
        yield fresh[_COLUMNS]

    def close(self) -> None:
        pass


class OpeningBalanceProcessor(BalanceProcessor):
    """The same, starting from committed balances."""

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self.balance.update((int(initial["balance"].iloc[0]),))


def stream_ledger(commands: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """The change history of a command stream, in append mode; the session's state store has to be RocksDB."""
    grouped = commands.groupBy("account_number")
    if opening is None:
        return grouped.transformWithStateInPandas(BalanceProcessor(), CHANGE_SCHEMA, "append", "none")
    return grouped.transformWithStateInPandas(OpeningBalanceProcessor(), CHANGE_SCHEMA, "append", "none", initialState=opening.groupBy("account_number"))
