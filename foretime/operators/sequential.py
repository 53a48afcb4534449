"""Folds whose steps depend on each other: ratings, caps and bankrolls.

They are serial within a group by nature, so groups (a league, a day, a strategy) run side by side.
Each streams through one sorted pass, so no group is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elo(games: DataFrame, k: float = 20.0, advantage: float = 50.0, start: float = 1500.0, regress: float = 1 / 3, successor: dict[str, str] | None = None) -> DataFrame:
    """league, game_id, home_rating, away_rating before each game.

    games: league, game_id, date, season, home, away, home_score, away_score, final. Games of a league come in order of date and id.
    With a new season a side moves by regress towards start; a side that follows another (successor: new name -> old) takes over its rating.
    Only final games with scores change ratings.
    """
    follows = dict(successor or {})

    def run(key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict[str, float] = {}
        seen: dict[str, int] = {}
        for frame in frames:
            out = []
            for g in frame.itertuples(index=False):
                for side in (g.home, g.away):
                    if side not in rating:
                        old = follows.get(side)
                        rating[side] = rating.get(old, start)
                        seen[side] = seen.get(old, g.season)
                    if seen[side] != g.season:
                        rating[side] += (start - rating[side]) * regress
                        seen[side] = g.season
                h, a = rating[g.home], rating[g.away]
                out.append((key[0], g.game_id, round(h, 1), round(a, 1)))
                if g.final and pd.notna(g.home_score) and pd.notna(g.away_score):
                    expected = 1 / (1 + 10 ** (-((h + advantage) - a) / 400))
                    won = 1.0 if g.home_score > g.away_score else 0.0 if g.home_score < g.away_score else 0.5
                    rating[g.home] += k * (won - expected)
                    rating[g.away] -= k * (won - expected)
            yield pd.DataFrame(out, columns=["league", "game_id", "home_rating", "away_rating"])

    types = {f.name: f.dataType.simpleString() for f in games.schema.fields}
    return sorted_runs(games, "league", ["date", "game_id"], run, f"league {types['league']}, game_id {types['game_id']}, home_rating double, away_rating double")


def sorted_runs(df: DataFrame, key: str, order: list[str], run, schema: str) -> DataFrame:
    """run((key,), frames) for each group with its rows in order; a group is streamed in batches and never held whole."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = _Runs(frames, key)
        while stream.more():
            value = stream.value
            yield from run((value,), stream.rows())

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(split, schema)


class _Runs:
    """Sorted frames as runs of equal keys."""

    def __init__(self, frames: Iterator[pd.DataFrame], key: str):
        self.frames, self.key, self.rest, self.value = frames, key, None, None

    def more(self) -> bool:
        while self.rest is None or not len(self.rest):
            self.rest = next(self.frames, None)
            if self.rest is None:
                return False
        self.value = self.rest[self.key].iloc[0]
        return True

    def rows(self) -> Iterator[pd.DataFrame]:
        value = self.value
        while self.more() and self.value == value:
            other = (self.rest[self.key] != value).to_numpy()
            cut = int(other.argmax()) if other.any() else len(self.rest)
            part, self.rest = self.rest.iloc[:cut], self.rest.iloc[cut:]
            yield part


def allocate(bets: DataFrame, day: list[str], item: str, edge: str, stake: str, order: list[Column], daily: float = 0.10, per_item: float = 0.04, most: int = 3) -> DataFrame:
    """bets with `kept`: taken in order (strongest first) while the day's and the item's caps hold; one that doesn't fit is skipped and the next tried.

    Days run side by side; the bets of a partition are streamed in the order of their day, and what is kept in memory are the sums of the items that the day has taken.
    """
    columns, orders = bets.columns, [f"__o{i}" for i in range(len(order))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, taken, last = 0.0, {}, None
        for frame in frames:
            if not len(frame):
                continue
            # a day begins where a row's day isn't that of the row before, in this frame or at the end of the last
            before = frame[day].shift()
            new = ((frame[day] != before) & ~(frame[day].isna() & before.isna())).to_numpy().any(axis=1)
            first = tuple(frame[day].iloc[0])
            new[0] = first != last
            last, kept = tuple(frame[day].iloc[-1]), []
            for begins, what, s in zip(new.tolist(), frame[item].tolist(), frame[stake].tolist()):
                if begins:
                    used, taken = 0.0, {}
                n, on_item = taken.get(what, (0, 0.0))
                fits = used + s <= daily + 1e-9 and on_item + s <= per_item + 1e-9 and n < most
                if fits:
                    used, taken[what] = used + s, (n + 1, on_item + s)
                kept.append(fits)
            yield frame[columns].assign(kept=kept)

    keyed = bets.withColumns(dict(zip(orders, order)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bets.schema.fields)
    return keyed.repartition(*day).sortWithinPartitions(*day, *orders).mapInPandas(run, f"{fields}, kept boolean")


def bankroll(bets: DataFrame, strategy: str, day: str, order: list[str], stake: str, gain: str, start: float = 1000.0, daily: float = 0.10) -> DataFrame:
    """strategy, day, bets, staked, pnl, balance, drawdown: stakes are shares of the balance in the morning, skipped once the day's cap is reached; gains are multiples of the stake."""

    def run(key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        balance, peak, now, used, pnl, n, morning = start, start, None, 0.0, 0.0, 0, start
        out: list[tuple] = []

        def close() -> None:
            nonlocal balance, peak
            balance += pnl
            peak = max(peak, balance)
            out.append((key[0], now, n, used * morning, pnl, balance, 1 - balance / peak))

        for frame in frames:
            for d, s, g in zip(frame[day], frame[stake], frame[gain]):
                if d != now:
                    if now is not None:
                        close()
                    now, used, pnl, n, morning = d, 0.0, 0.0, 0, balance
                if used + s <= daily + 1e-9:
                    used, n = used + s, n + 1
                    pnl += g * s * morning
        if now is not None:
            close()
        yield pd.DataFrame(out, columns=["strategy", "day", "bets", "staked", "pnl", "balance", "drawdown"])

    types = {f.name: f.dataType.simpleString() for f in bets.schema.fields}
    return sorted_runs(bets, strategy, [day, *order], run, f"strategy {types[strategy]}, day {types[day]}, bets long, staked double, pnl double, balance double, drawdown double")


def anchored_clusters(df: DataFrame, keys: list[str], seconds: str, span: int) -> DataFrame:
    """keys, first, members: instants (whole seconds) in order; a new cluster begins when one is over span after its cluster's first. Unlike gap sessions, a cluster never spans more. A group is streamed in order."""

    def run(key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, own = None, 0, None
        for frame in frames:
            out = []
            own = tuple(frame.iloc[0][keys])
            for t in frame["__at"].tolist():
                if first is not None and t - first <= span:
                    n += 1
                    continue
                if first is not None:
                    out.append((*own, first, n))
                first, n = t, 1
            yield pd.DataFrame(out, columns=[*keys, "first", "members"])
        if first is not None:
            yield pd.DataFrame([(*own, first, n)], columns=[*keys, "first", "members"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keyed = df.select(*keys, F.col(seconds).cast("long").alias("__at"), F.to_json(F.struct(*keys)).alias("__key"))
    return sorted_runs(keyed, "__key", ["__at"], run, ", ".join(f"{k} {types[k]}" for k in keys) + ", first long, members long")
