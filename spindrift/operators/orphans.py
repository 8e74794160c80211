"""References to records that do not exist, or not at the time of the reference.

A child row names a parent key at an instant. Parents are in force from ``valid_from`` (inclusive) to ``valid_to`` (exclusive,
null = still). The instant is first reduced to the parent key's epoch (how many of its borders lie at or before it), so that
the distinct non-null references are (key, epoch) pairs, few whatever the number of rows. They are anti-joined against the
(key, epoch) pairs in force, classified, and joined back to the rows or to counts by table and period.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.scale import bounded_broadcast, written


@dataclass(frozen=True)
class Child:
    """One referring table: its rows, row id, foreign key and the instant of the reference."""

    name: str
    rows: DataFrame
    row_id: str
    key: str
    at: str


def _borders(parents: DataFrame) -> DataFrame:
    """(k, borders): the sorted distinct borders of each parent key."""
    return (
        parents.select("k", F.explode(F.array("valid_from", "valid_to")).alias("border"))
        .groupBy("k")
        .agg(F.array_sort(F.collect_set("border")).alias("borders"))
    )


def _epoch(borders: Column, at: Column) -> Column:
    """How many borders lie at or before ``at``; 0 for an unknown key, null without an instant."""
    return F.when(at.isNull(), None).otherwise(F.coalesce(F.size(F.filter(borders, lambda b: b <= at)), F.lit(0)))


class References:
    """The references of several child tables to one parent table.

    * Null foreign keys refer to nothing and are never orphans.
    * A null instant: nothing can be said about its time, so it is an orphan (``missing``) only if the key never exists.
    * A parent row with a null key or a null ``valid_from`` is never in force; repeated parent rows count once.
    * ``kind``: ``missing`` the key never exists, ``late`` all its rows begin after the instant, else ``removed``.
    * Keys are compared in the common type of all key columns (``key_type``): whole numbers as bigint, with decimals as
      decimals, with floats as doubles (5.0 is 5, 5.5 a key like any other; NaN refers to nothing), texts as they are, and
      texts with numbers by the number they spell, else as they are. Row ids stay bigint if all are whole numbers.
    """

    def __init__(self, parents: DataFrame, key: str, valid_from: str, valid_to: str) -> None:
        self.given = parents.select(parents[key].alias("k"), parents[valid_from].alias("valid_from"), parents[valid_to].alias("valid_to"))

    def _begin(self, children: list[Child]) -> None:
        """Brings the parents' keys to the type they share with the children's."""
        kinds = [self.given.schema["k"].dataType, *(c.rows.schema[c.key].dataType for c in children)]
        self.as_key = key_type(kinds)
        self.id_type = "bigint" if all(c.rows.schema[c.row_id].dataType.typeName() in WHOLE for c in children) else "string"
        self.parents = self.given.withColumn("k", self.as_key(self.given["k"], kinds[0])).where("k IS NOT NULL AND valid_from IS NOT NULL").distinct()
        self.borders = bounded_broadcast(_borders(self.parents))

    def _placed(self, child: Child, *extra: Column) -> DataFrame:
        rows = child.rows
        key = self.as_key(rows[child.key], rows.schema[child.key].dataType)
        refs = rows.select(F.lit(child.name).alias("table_name"), rows[child.row_id].cast(self.id_type).alias("row_id"), key.alias("k"), rows[child.at].alias("at"), *extra).where("k IS NOT NULL")
        joined = refs.join(self.borders, "k", "left")
        return joined.withColumn("epoch", _epoch(F.col("borders"), F.col("at"))).drop("borders")

    def orphan_keys(self, children: list[Child]) -> DataFrame:
        """(k, epoch, kind): the distinct references without a parent in force."""
        self._begin(children)
        distinct = None
        for child in children:
            part = self._placed(child).select("k", "epoch").distinct()
            distinct = part if distinct is None else distinct.unionByName(part)
        # written, so that the rows are read once for the joins below, which see the few distinct references only
        distinct = written(distinct.distinct(), "references")
        ranges = self.parents.join(self.borders, "k").select(
            "k",
            _epoch(F.col("borders"), F.col("valid_from")).alias("first"),
            F.coalesce(_epoch(F.col("borders"), F.col("valid_to")) - 1, F.size("borders")).alias("last"),
        )
        valid = ranges.where("first <= last").select("k", F.explode(F.sequence("first", "last")).alias("epoch"))
        known = self.parents.groupBy("k").agg(F.min("valid_from").alias("begins")).join(self.borders, "k").select("k", _epoch(F.col("borders"), F.col("begins")).alias("begins"))
        timed = distinct.join(valid, ["k", "epoch"], "left_anti").where("epoch IS NOT NULL")
        untimed = distinct.where("epoch IS NULL").join(known, "k", "left_anti")
        kind = F.when(F.col("begins").isNull(), "missing").when(F.col("epoch") < F.col("begins"), "late").otherwise("removed")
        return timed.unionByName(untimed).join(known, "k", "left").select("k", "epoch", kind.alias("kind"))

    def orphan_rows(self, children: list[Child]) -> DataFrame:
        """(table_name, row_id, kind): the rows whose reference is an orphan."""
        keys = self._written_keys(children)
        return self._all(children, keys).select("table_name", "row_id", "kind")

    def report(self, children: list[Child], period: str = "month") -> DataFrame:
        """(table_name, period, kind, n_rows, n_keys): orphan references by table and period of the instant (null: no instant)."""
        keys = self._written_keys(children)
        rows = self._all(children, keys, F.date_trunc(period, F.col("at")).alias("period"))
        by_key = rows.groupBy("table_name", "period", "kind", "k").agg(F.count(F.lit(1)).alias("n"))
        return by_key.groupBy("table_name", "period", "kind").agg(F.sum("n").alias("n_rows"), F.count("k").alias("n_keys"))

    def _written_keys(self, children: list[Child]) -> DataFrame:
        """``orphan_keys``, found once: they are counted and joined to every child."""
        return bounded_broadcast(written(self.orphan_keys(children), "orphan-keys"))

    def _all(self, children: list[Child], keys: DataFrame, *extra: Column) -> DataFrame:
        out = None
        for child in children:
            placed = self._placed(child).select("table_name", "row_id", "k", "epoch", "at").select("*", *extra)
            orphan = keys.withColumnsRenamed({"k": "ok", "epoch": "oe"})
            part = placed.join(orphan, (F.col("k") == F.col("ok")) & F.col("epoch").eqNullSafe(F.col("oe"))).drop("ok", "oe", "at", "epoch")
            out = part if out is None else out.unionByName(part)
        return out


WHOLE = ("byte", "short", "integer", "long")


def key_type(kinds: list[T.DataType]) -> Callable[[Column, T.DataType], Column]:
    """A function that brings a key column of one of ``kinds`` to the type all of them can be compared in."""
    names = {k.typeName() for k in kinds}
    number = lambda c, kind: F.when(~F.isnan(c), c + F.lit(0.0)) if kind.typeName() in ("float", "double") else c
    if names <= {*WHOLE}:
        return lambda c, kind: c.cast("bigint")
    if names <= {*WHOLE, "decimal"}:
        scale = max(k.scale for k in kinds if isinstance(k, T.DecimalType))
        return lambda c, kind: c.cast(f"decimal(38,{scale})")
    if names <= {*WHOLE, "decimal", "float", "double"}:
        return lambda c, kind: number(c, kind).cast("double")
    if len(names) == 1:
        return lambda c, kind: c.cast("string")
    spelled = lambda c: F.coalesce((F.trim(c).try_cast("double") + F.lit(0.0)).cast("string"), c)
    return lambda c, kind: number(c, kind).cast("double").cast("string") if kind.typeName() in (*WHOLE, "decimal", "float", "double") else spelled(c.cast("string"))
