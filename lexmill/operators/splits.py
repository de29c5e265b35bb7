"""Leakage-safe splits: session prefixes, subset sums, protected groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import stable_rank


def development_sessions(sessions: DataFrame, fraction: float, seed: str) -> DataFrame:
    """Sessions (airport, recorded_date, seconds) for development.

    Per airport, in rank order, sessions join while the sum before them is
    below ``fraction`` of the airport's seconds; the last never joins. Airports
    with one session then join, in rank order, while the whole is below target.
    """
    rank = stable_rank(seed, F.concat_ws(":", "airport", F.col("recorded_date").cast("string")))
    ranked = sessions.withColumn("rank", rank)
    here = Window.partitionBy("airport")
    before = here.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.select(
        "*", F.count("*").over(here).alias("n"), F.row_number().over(here.orderBy("rank")).alias("place"), F.coalesce(F.sum("seconds").over(before), F.lit(0.0)).alias("before"), (F.sum("seconds").over(here) * fraction).alias("target")
    )
    several = placed.where((F.col("n") > 1) & (F.col("place") < F.col("n")) & (F.col("before") < F.col("target"))).select("airport", "recorded_date", "seconds")
    totals = sessions.agg((F.sum("seconds") * fraction).alias("whole")).crossJoin(several.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("chosen")))
    order = Window.orderBy(stable_rank(seed, F.concat(F.lit("singleton:"), "airport"))).rowsBetween(Window.unboundedPreceding, -1)
    single = placed.where("n = 1").withColumn("sum_before", F.coalesce(F.sum("seconds").over(order), F.lit(0.0))).crossJoin(F.broadcast(totals))
    return several.unionByName(single.where("chosen + sum_before < whole").select("airport", "recorded_date", "seconds"))


class FirstReaching:
    """For every sum up to ``most``, the place of the item whose turn first made it reachable.

    Items have their turns in order and count once. Sum 0 is reachable before
    the first turn and holds the number of items. Following a sum down, each
    time less the size of its item, spells out its subset. Reachable sums are
    listed while they are few against ``most``, however large they are; once
    they are many, one small number is kept for every sum.
    """

    #: Sums that are looked at together.
    STEP = 1 << 20

    def __init__(self, sizes: list[int], most: int, stop_at: int | None = None):
        self.sizes, self.table = sizes, None
        self.sums, self.places = np.zeros(1, np.int64), np.array([len(sizes)], np.int32)
        for place, size in enumerate(sizes):
            if 0 < size <= most:
                if self.table is None and len(self.sums) > max(most >> 5, 1 << 12):
                    self.table = np.full(most + 1, -1, np.int16 if len(sizes) < 1 << 15 else np.int32)
                    self.table[self.sums] = self.places
                    self.sums = self.places = None
                (self._list if self.table is None else self._mark)(place, size, most)
                if stop_at is not None and self.place_of(stop_at) >= 0:
                    break

    def _list(self, place: int, size: int, most: int) -> None:
        fresh = self.sums[: np.searchsorted(self.sums, most - size, "right")] + size
        at = np.searchsorted(self.sums, fresh)
        new = self.sums[np.minimum(at, len(self.sums) - 1)] != fresh
        self.sums, self.places = np.insert(self.sums, at[new], fresh[new]), np.insert(self.places, at[new], place)

    def _mark(self, place: int, size: int, most: int) -> None:
        # From above, so that no sum counts the item twice.
        for last in range(most + 1, size, -self.STEP):
            first = max(size, last - self.STEP)
            below, here = self.table[first - size : last - size], self.table[first:last]
            here[(below >= 0) & (below != place) & (here < 0)] = place

    def place_of(self, total: int) -> int:
        """-1 for a sum out of reach."""
        if self.table is not None:
            return int(self.table[total]) if 0 <= total < len(self.table) else -1
        at = np.searchsorted(self.sums, total)
        return int(self.places[at]) if at < len(self.sums) and self.sums[at] == total else -1

    def near(self, target: int, without: tuple[int, ...] = ()) -> list[int]:
        """The reachable sums that are nearest to ``target``, rising: one, two or none."""
        if self.table is None:
            sums = self.sums[~np.isin(self.sums, without)]
            away = np.abs(sums - target)
            return [int(s) for s in sums[away == away.min()]] if len(sums) else []
        size = len(self.table)
        for away in range(0, max(target + 1, size - target), self.STEP):
            found = []
            for first, last in {(max(0, target - away - self.STEP), target - away + 1), (target + away, target + away + self.STEP + 1)}:
                found += [s for s in (np.flatnonzero(self.table[max(0, first) : max(0, last)] >= 0) + max(0, first)).tolist() if s not in without]
            if found:
                least = min(abs(s - target) for s in found)
                return sorted({s for s in found if abs(s - target) == least})
        return []

    def spelled_out(self, total: int) -> list[int]:
        """Places, in order, of the items that make up ``total``."""
        places = []
        while total:
            places.append(self.place_of(total))
            total -= self.sizes[places[-1]]
        return places[::-1]


def nearest_subset(ticks: list[int], target: int, whole_allowed: bool = True, tie=None) -> list[int]:
    """Places of items whose sum is nearest to the target; never none, and not all if so asked.

    Of two sums as near, the one whose places have the smaller ``tie`` (a
    function of them) is taken; without it, the smaller sum.
    """
    without = (0,) if whole_allowed else (0, sum(ticks))
    # Where the target itself is reached, later turns change nothing.
    reached = FirstReaching(ticks, target + max(ticks, default=0), None if target in without else target)
    near = [reached.spelled_out(s) for s in reached.near(target, without)]
    if not near:
        return []
    return min(near, key=tie) if tie else near[0]


def subset_per_group(groups: DataFrame, by: str, key: str, seconds: str, fraction: float, seed: int) -> DataFrame:
    """(by, key, seconds, chosen): within each ``by``, a subset of groups near ``fraction`` of its seconds, at tenths of a second, never all.

    Of two subsets as near, the one whose digest (of seed and keys) is smaller.
    A group of groups (the days of an airport) is small by nature: one task
    holds its keys and totals, not its rows.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_r=[hashlib.sha256(f"{seed}:{a}|{k}".encode()).hexdigest() for a, k in zip(part[by], part[key])]).sort_values("_r", ignore_index=True)
        ticks = [max(1, int(np.round(s * 10))) for s in part[seconds]]
        names = list(zip(part[by], part[key]))
        digest = lambda places: hashlib.sha256(f"{seed}:{tuple(names[i] for i in places)!r}".encode()).hexdigest()
        chosen = set(nearest_subset(ticks, int(np.round(part[seconds].sum() * fraction * 10)), whole_allowed=False, tie=digest))
        return pd.DataFrame({by: part[by], key: part[key], seconds: part[seconds], "chosen": [i in chosen for i in range(len(part))]})

    return groups.select(by, key, seconds).groupBy(by).applyInPandas(run, f"{by} string, {key} string, {seconds} double, chosen boolean")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Places of the items that fill the capacity best; of equal fills the one reached earliest in the list."""
    if capacity < 0 or min(lengths, default=0) < 0:
        raise ValueError("lengths and capacity must not be negative")
    reached = FirstReaching(lengths, capacity, stop_at=capacity)
    return reached.spelled_out(reached.near(capacity)[0])
