"""First-fit windows of drifting reset times, over many tasks.

The rule is sequential: a reading joins the first window, in the order of opening, whose latest reset time is within
five minutes of its own, lifts that time to its own if later, and else opens a window. Seen window by
window it is not: the first window of a group begins with the first reading and takes whatever comes near
enough; what it leaves is the stream in which the second window does the same, and so on.

For one window, a reading r sends its latest time v to r if r - 300 <= v < r, and leaves it otherwise. That is a
non-decreasing step function, and so is any sequence of readings: a few intervals of v with the value each ends at,
and nothing else moved. So each chunk of a group is summed up by its steps, the steps of a group's chunks are followed
from its first reading, one small row a chunk, and then every chunk knows where it starts and tells which of its
readings the window takes. All chunks of all groups work at once, once per window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.storage import Scratch

#: Rows of a chunk, and of what is left when the sequential rule may finish in one task a group.
CHUNK_ROWS = 100_000


class Steps:
    """A non-decreasing step function on whole numbers: values in [low, high) become the target, all others stay."""

    def __init__(self, low: Iterable[int] = (), high: Iterable[int] = (), target: Iterable[int] = ()):
        self.low, self.high, self.target = list(low), list(high), list(target)

    def then(self, reading: int, jitter: int) -> None:
        """Follow the function by one reading: what has become a value in [reading - jitter, reading) becomes the reading."""
        first = bisect_left(self.target, reading - jitter)
        last = bisect_left(self.target, reading)
        low = max(reading - jitter, self.high[first - 1] if first else reading - jitter)
        if first < len(self.low):
            low = min(low, self.low[first])
        high = min(reading, self.low[last]) if last < len(self.low) else reading
        if last:
            high = max(high, self.high[last - 1])
        if low < high:
            # Intervals ending at this very reading stay beside the new one.
            self.low[first:last], self.high[first:last], self.target[first:last] = [low], [high], [reading]

    def __call__(self, value: int) -> int:
        i = bisect_right(self.low, value) - 1
        return self.target[i] if i >= 0 and value < self.high[i] else value


def first_fit(readings: Iterable[int], jitter: int) -> list[int]:
    """The window, from 0, of each reading of one group, by the sequential rule."""
    opened: list[int] = []
    out = []
    for r in readings:
        for i, latest in enumerate(opened):
            if abs(latest - r) <= jitter:
                opened[i] = max(latest, r)
                break
        else:
            i = len(opened)
            opened.append(r)
        out.append(i)
    return out


def first_fit_windows(readings: DataFrame, group: list[str], value: str, order: list[str], jitter: int, scratch: Scratch,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`readings` with `part`: the number of the window that each joins within its group, in the order given.

    `value` is a whole number. Each window costs a pass over what earlier windows left; once no more than
    `chunk_rows` readings are left in all, one task per group finishes. The result reads tables of `scratch`.
    """
    columns = readings.columns
    # Ranges of the whole order: a chunk is the part of a group within one range.
    ranges = max(1, -(-readings.count() // chunk_rows))
    ranged = scratch.store(readings.repartitionByRange(ranges, *group, *order).withColumn("_chunk", F.spark_partition_id()), "ranged")
    unit = [*group, "_chunk"]
    along = Window.partitionBy(*unit).orderBy(*order)
    # A repeat of the value before it joins the same window, so only the others decide.
    placed = scratch.store(ranged.withColumn("_place", F.row_number().over(along)).withColumn("_before", F.lag(value).over(along)), "placed")
    changes = F.col("_before").isNull() | (F.col("_before") != F.col(value))
    left = scratch.store(placed.filter(changes).select(*unit, "_place", F.col(value).cast("long").alias("_value")), "left")

    def schema(*names: str) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema if f.name in names)

    def summed_up(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("_place")["_value"].tolist()
        steps = Steps()
        for r in values:
            steps.then(r, jitter)
        row = {c: part[c].iloc[0] for c in unit}
        return pd.DataFrame([row | {"low": steps.low, "high": steps.high, "target": steps.target, "first": values[0]}])

    def followed(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_chunk")
        # The window begins with the group's first reading, which then takes itself.
        latest, starts = int(chunks["first"].iloc[0]), []
        for low, high, target in zip(chunks["low"], chunks["high"], chunks["target"]):
            starts.append(latest)
            latest = Steps(low, high, target)(latest)
        return chunks[unit].assign(start=starts)

    def told(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        latest, taken = int(start["start"].iloc[0]), []
        for r in part["_value"].tolist():
            near = abs(latest - r) <= jitter
            taken.append(near)
            if near:
                latest = max(latest, r)
        return part.assign(taken=taken)

    def finished(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_chunk", "_place"])
        return part[[*unit, "_place"]].assign(part=first_fit(part["_value"].tolist(), jitter))

    parts, window = [], 0
    while left.count() > chunk_rows:
        steps = left.groupBy(*unit).applyInPandas(summed_up, schema(*unit) + ", low array<long>, high array<long>, target array<long>, first long")
        starts = steps.groupBy(*group).applyInPandas(followed, schema(*unit) + ", start long")
        marked = scratch.store(left.groupBy(*unit).cogroup(starts.groupBy(*unit)).applyInPandas(told, schema(*left.columns) + ", taken boolean"), "told")
        parts.append(marked.filter("taken").select(*unit, "_place", F.lit(window).alias("part")))
        left = marked.filter("NOT taken").drop("taken")
        window += 1
    rest = left.groupBy(*group).applyInPandas(finished, schema(*unit, "_place") + ", part int")
    parts.append(rest.withColumn("part", F.col("part") + window))
    joined = placed.join(reduce(DataFrame.unionByName, parts), [*unit, "_place"], "left")
    upto = Window.partitionBy(*unit).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("part", F.last("part", ignorenulls=True).over(upto)).select(*columns, "part")
