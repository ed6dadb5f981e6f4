"""Running values over long ordered groups.

A plain window puts a whole group in one task. Here the rows of a group are cut into chunks that
follow the group's order, each chunk is scanned on its own, and what earlier chunks leave behind is
carried in from one small row per chunk. The result equals the plain window for any chunking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.storage import materialize


@dataclass(frozen=True)
class Running:
    """A running value: ``last`` non-null, ``min``, ``max`` or ``sum`` of an expression.

    ``before`` leaves the current row out.
    """

    kind: str
    expr: Column
    before: bool = False


def _fold(kind: str, c: Column) -> Column:
    if kind == "last":
        return F.last(c, ignorenulls=True)
    return {"min": F.min, "max": F.max, "sum": F.sum}[kind](c)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "sum":
        both = local + carried
        return F.coalesce(both, local, carried)
    better = (carried < local) if kind == "min" else (carried > local)
    return F.when(local.isNull() | better, F.coalesce(carried, local)).otherwise(local)


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    values: dict[str, Running],
    descending: bool = False,
    carried_rows: Column | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add running values along ``order`` within ``keys``.

    ``chunk`` must follow the order (never decrease along it). ``carried_rows`` may name the rows
    that can matter to a later chunk, so the summary pass can skip groups known to be one chunk.
    ``initial`` has, per key, what rows before the given ones left behind (see ``closing``).
    """
    along = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*along)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    ahead = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[
            _fold(v.kind, v.expr).over(ahead if v.before else upto).alias(f"_l_{n}")
            for n, v in values.items()
        ],
    )

    position = F.struct(*order)
    pick = F.min_by if descending else F.max_by

    def whole(v: Running) -> Column:
        if v.kind == "last":
            return pick(v.expr, F.when(v.expr.isNotNull(), position))
        return _fold(v.kind, v.expr)

    rows = df if carried_rows is None else df.filter(carried_rows)
    chunks = rows.groupBy(*keys, chunk).agg(
        *[whole(v).alias(f"_t_{n}") for n, v in values.items()]
    )
    across = Window.partitionBy(*keys).orderBy(
        F.col(chunk).desc() if descending else F.col(chunk).asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *keys,
        chunk,
        *[_fold(v.kind, F.col(f"_t_{n}")).over(across).alias(f"_c_{n}") for n, v in values.items()],
    )
    joined = local.join(carried, [*keys, chunk], "left")
    merged = {n: _merge(v.kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, v in values.items()}
    if initial is not None:
        joined = joined.join(_named(initial, keys, values, "_i_"), keys, "left")
        merged = {n: _merge(v.kind, merged[n], F.col(f"_i_{n}")) for n, v in values.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in merged.items()])


def _named(df: DataFrame, keys: list[str], values: dict[str, Running], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(n).alias(prefix + n) for n in values])


def closing(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running],
    initial: DataFrame | None = None,
) -> DataFrame:
    """What the rows of each group leave behind: the running values after the last of them.

    ``order`` must include the chunk, and ``initial`` is as in ``running``; its groups without rows
    come back unchanged.
    """
    position = F.struct(*order)
    ends = df.groupBy(*keys).agg(*[
        (F.max_by(v.expr, F.when(v.expr.isNotNull(), position)) if v.kind == "last"
         else _fold(v.kind, v.expr)).alias(n) for n, v in values.items()])
    if initial is None:
        return ends
    both = _named(ends, keys, values, "_e_").join(
        _named(initial, keys, values, "_i_"), keys, "full_outer")
    return both.select(*keys, *[
        _merge(v.kind, F.col(f"_e_{n}"), F.col(f"_i_{n}")).alias(n) for n, v in values.items()])


def even_ranges(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``_chunk``, their number of even range along keys and order.

    The table is stored, because both passes of ``running`` must see the same ranges.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return materialize(ranged.withColumn("_chunk", F.spark_partition_id()), name)


def time_chunk(ts: Column, seconds: int = 3600) -> Column:
    """Chunk number of an instant; follows time order."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")
