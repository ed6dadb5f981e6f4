"""Stored tables whose parts are replaced one by one.

Rows lie in parts, by a hash of their key or by date. A change writes the touched parts anew, below the name
of the change, and a list of the live parts of all tables is published in one step: readers see all of a
change or nothing of it, and a change that failed leaves only folders that nothing refers to.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterlake.sources.ledger import LedgerError, newest_pointer, publish
from meterlake.storage import delete_folder, folder_names

PART = "part_key"


def part_of(parts: int, *keys: Column | str) -> Column:
    """Number of the part of a key, as text."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string").alias(PART)


@dataclass
class Parts:
    """The tables of one version of a store, and the changes being made to them.

    `live` tells, table by table, below which change each part lies; `schemas` the columns of each table.
    """

    spark: SparkSession
    root: str
    number: int = 0
    live: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Parts:
        """The current version; an empty one if there is none."""
        try:
            number, version, _ = newest_pointer(spark, root)
        except LedgerError:
            return cls(spark, root)
        # One row per part: as many as tables times parts, whatever the number of rows.
        rows = spark.read.parquet(f"{root}/versions/{version}").collect()
        out = cls(spark, root, number)
        for row in rows:
            if row["part"] is None:
                getattr(out, row["kind"])[row["name"]] = row["value"]
            else:
                out.live.setdefault(row["name"], {})[row["part"]] = row["value"]
        return out

    def read(self, table: str, parts: set[str] | None = None) -> DataFrame:
        """A table, or some of its parts. It must have been written once."""
        schema = StructType.fromJson(json.loads(self.schemas[table]))
        held = self.live.get(table, {})
        paths = [f"{self.root}/{table}/{change}/{PART}={part}" for part, change in sorted(held.items())
                 if parts is None or part in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def replace(self, table: str, rows: DataFrame, change: str, touched: set[str]) -> None:
        """Write the touched parts of a table anew from `rows`, which name their part; parts without rows go."""
        path = f"{self.root}/{table}/{change}"
        self.schemas[table] = StructType([f for f in rows.schema if f.name != PART]).json()
        # Rebalancing splits a part that holds much and joins small ones.
        rows.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(path)
        held = self.live.setdefault(table, {})
        for part in touched:
            held.pop(part, None)
        for name in folder_names(self.spark, path):
            if name.startswith(f"{PART}="):
                held[name.removeprefix(f"{PART}=")] = change

    def publish(self, change: str, generated_at) -> int:
        """Make this state the current one; fails if another writer has published meanwhile."""
        rows = [("live", table, part, where) for table, held in self.live.items() for part, where in held.items()]
        rows += [(kind, name, None, value) for kind in ("schemas", "settings") for name, value in getattr(self, kind).items()]
        self.spark.createDataFrame(rows, "kind string, name string, part string, value string").coalesce(1).write.parquet(
            f"{self.root}/versions/{change}")
        self.number = publish(self.spark, self.root, change, generated_at, after=self.number)
        return self.number

    def remove_dead(self) -> int:
        """Remove the folders of changes that hold no live part; tells how many. Nothing may be reading old versions."""
        gone = 0
        for table in {*self.live, *self.schemas}:
            needed = set(self.live.get(table, {}).values())
            for change in folder_names(self.spark, f"{self.root}/{table}"):
                if change not in needed:
                    delete_folder(self.spark, f"{self.root}/{table}/{change}")
                    gone += 1
        return gone
