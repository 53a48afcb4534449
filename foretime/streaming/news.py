"""News of starters: a plan over stored snapshots, and a stream with state by team that gives the same.

A snapshot says who is expected to start for a team on a game date, and whether that is confirmed. News are: a confirmed starter
(of a new date, or the same one confirmed now), another starter for the same date, and a starter no longer confirmed. The
first projection for a date is none.
"""

from __future__ import annotations

import datetime as dt
import unicodedata
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DateType, LongType, StringType, StructField, StructType

from foretime.functions.text import folded

CONFIRMED, CHANGED = "STARTER_CONFIRMED", "STARTER_CHANGED"


def _told(same_date: Column, was: Column, was_confirmed: Column, goalie: Column, confirmed: Column) -> Column:
    other = folded(was) != folded(goalie)
    return (
        F.when(~same_date, F.when(confirmed, CONFIRMED))
        .when(other, CHANGED)
        .when(confirmed & ~was_confirmed, CONFIRMED)
        .when(~confirmed & was_confirmed, CHANGED)
    )


def starter_news(df: DataFrame) -> DataFrame:
    """team, ts, game_date, kind, goalie, previous of snapshots (team, ts, game_date, goalie, confirmed): each is held against the team's snapshot before."""
    w = Window.partitionBy("team").orderBy("ts")
    before = lambda c: F.lag(c).over(w)
    rows = df.withColumns({"__same": F.coalesce(before("game_date") == F.col("game_date"), F.lit(False)), "previous": before("goalie"), "__was": F.coalesce(before("confirmed"), F.lit(False))})
    rows = rows.withColumn("kind", _told(F.col("__same"), F.col("previous"), F.col("__was"), F.col("goalie"), F.coalesce("confirmed", F.lit(False)))).filter("kind IS NOT NULL")
    return rows.select("team", "ts", "game_date", "kind", "goalie", F.when(F.col("__same"), F.col("previous")).alias("previous"))


_KEY = StructType([StructField("game_date", DateType())])
_STATE = StructType([StructField("goalie", StringType()), StructField("confirmed", BooleanType()), StructField("ts", LongType())])


def _same(a: str, b: str) -> bool:
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold()
    return plain(a) == plain(b)


class StarterNews(StatefulProcessor):
    """The state of a team: a map from game date to who was listed last. Snapshots not newer than the last one seen are late and go; an event-time timer clears a date KEEP_DAYS after it."""

    KEEP_DAYS = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.listed = handle, handle.getMapState("listed", _KEY, _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = {k[0]: tuple(v) for k, v in self.listed.iterator()}
        seen = max((v[2] for v in state.values()), default=None)
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):  # of one team and one trigger
            at, confirmed = r.ts.value // 1000, bool(r.confirmed)
            if seen is not None and at <= seen:
                continue
            # the snapshot before is that of the latest date listed, unless this date was listed
            last = max(state, key=lambda d: state[d][2]) if state else None
            was = state[last] if last == r.game_date else None
            kind = None
            if was is None:
                kind = CONFIRMED if confirmed else None
            elif not _same(was[0], r.goalie):
                kind = CHANGED
            elif confirmed != was[1]:
                kind = CONFIRMED if confirmed else CHANGED
            if kind:
                out.append((key[0], r.ts, r.game_date, kind, r.goalie, was[0] if was else None))
            state[r.game_date] = (r.goalie, confirmed, at)
            self.listed.updateValue((r.game_date,), state[r.game_date])
            self.handle.registerTimer(self._until(r.game_date))
            seen = at
        yield pd.DataFrame(out, columns=["team", "ts", "game_date", "kind", "goalie", "previous"])

    def _until(self, day: dt.date) -> int:
        return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp() * 1000) + self.KEEP_DAYS * 86_400_000

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = {k[0]: tuple(v) for k, v in self.listed.iterator()}
        latest = max(state.values(), key=lambda v: v[2], default=None)
        for day, value in state.items():
            if self._until(day) <= now and value != latest:  # what was listed last stays, to hold the next one against
                self.listed.removeKey((day,))
        yield pd.DataFrame([], columns=["team", "ts", "game_date", "kind", "goalie", "previous"])

    def close(self) -> None:
        pass


def starter_news_stream(df: DataFrame, late: str = "1 day") -> DataFrame:
    """The same of a stream of snapshots. Needs the state store of RocksDB (see use_rocksdb)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"team {types['team']}, ts timestamp, game_date date, kind string, goalie string, previous string"
    return df.withWatermark("ts", late).groupBy("team").transformWithStateInPandas(StarterNews(), out, "Append", "EventTime")


def use_rocksdb(spark) -> None:
    """State by key with maps and timers is kept in RocksDB: on the executors' disks, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
