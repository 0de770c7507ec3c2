"""Results that arrive step by step: measures of each step, extremes by window, and the running maximum of each load path."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.results import postprocess

RESULTS = "microstructure string, load_case string, time_step int, quantity string, point_id long, value array<double>, at timestamp"


def read_steps(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of results as they arrive in a folder."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def streamed_measures(steps: DataFrame, quantities: list[str], measures: list[str] | None = None) -> DataFrame:
    """Rank-2 measures of every arriving row; stateless."""
    return postprocess(steps, quantities, measures)


def running_maximum(measured: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Greatest first component by window, microstructure, load case and quantity; rows later than ``late`` are left out."""
    window = F.window("at", width)
    return measured.withWatermark("at", late).groupBy(window.alias("window"), "microstructure", "load_case", "quantity").agg(F.max(F.get("value", 0)).alias("greatest"), F.count("*").alias("rows"))


PATH = ("microstructure", "load_case", "quantity")
MAXIMA = "microstructure string, load_case string, quantity string, greatest double, at_step int, rows long, ended boolean"
#: The state store that keeps values and timers for each load path.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PathMaximum(StatefulProcessor):
    """State of one load path: the greatest first component so far, the step it came in, and how many rows there were."""

    def __init__(self, idle: timedelta) -> None:
        self.idle = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("maximum", "greatest double, at_step int, rows long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        greatest, at_step, n, last = self.value.get() if self.value.exists() else (None, None, 0, None)
        before = last
        for part in rows:
            n += len(part)
            newest = int(part["at"].max().timestamp() * 1000)
            last = newest if last is None else max(last, newest)
            known = part[part["first"].notna()]
            if len(known):
                # of equal maxima the earliest step counts, in whatever order rows arrive
                top = known[known["first"] == known["first"].max()].nsmallest(1, "time_step").iloc[0]
                if greatest is None or (top["first"], -top["time_step"]) > (greatest, -at_step):
                    greatest, at_step = float(top["first"]), int(top["time_step"])
        self.value.update((greatest, at_step, n, last))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
        yield self._row(key, greatest, at_step, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            greatest, at_step, n, _ = self.value.get()
            self.value.clear()
            yield self._row(key, greatest, at_step, n, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, greatest, at_step, n: int, ended: bool) -> pd.DataFrame:
        row = pd.DataFrame([[*key, greatest, at_step, n, ended]], columns=[*PATH, "greatest", "at_step", "rows", "ended"])
        return row.astype({"greatest": "float64", "at_step": "Int32", "rows": "int64"})


def path_maxima(measured: DataFrame, late: str = "10 minutes", idle: timedelta = timedelta(hours=6)) -> DataFrame:
    """Running maximum of the first component over the whole of each load path, however long it takes (update mode).

    A row for each path of a batch: the maximum so far, the earliest step that has it, and rows so far. Steps may arrive in any
    order; those later than the watermark (``late`` behind the newest) are left out. A path without a row for ``idle`` of event
    time ends: its last row is marked, and its state goes. Values, counts and timers are kept in a state store, so a restart
    from a checkpoint goes on where the query stopped. Null values count as rows only; the session needs the store of
    ``use_state_store``.
    """
    rows = measured.withWatermark("at", late).select(*PATH, "time_step", F.get("value", 0).cast("double").alias("first"), "at")
    return rows.groupBy(*PATH).transformWithStateInPandas(PathMaximum(idle), MAXIMA, "Update", "eventTime")


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that running maxima need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
