"""Links from entities to the surfaces that reach them, by many kinds of evidence in one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Evidence:
    """Kinds of evidence by which an entity and a record of a surface are one, declared and joined at once.

    ``anchor`` tells rows that name an entity, ``target`` rows of a surface, each with the keys they
    have by kind: the same file, the entity itself, a name whatever its letters' case, a path of a key.
    A link is an equal key of one kind. Kinds count in the order in which they are first declared.
    """

    def __init__(self):
        self.kinds: list[str] = []
        self.anchors: list[DataFrame] = []
        self.targets: list[DataFrame] = []

    def _keyed(self, rows: DataFrame, keys: dict[str, Column], *columns: Column) -> DataFrame:
        self.kinds += [k for k in keys if k not in self.kinds]
        told = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in keys.items()]))
        return rows.select(*columns, told.alias("_k")).where("_k.key is not null and trim(_k.key) != ''").select(*[F.col(c) for c in rows.select(*columns).columns], "_k.kind", "_k.key")

    def anchor(self, rows: DataFrame, entity: Column, **keys: Column) -> Evidence:
        """Rows that name an entity; null and blank keys are none."""
        self.anchors.append(self._keyed(rows, keys, entity.alias("entity")))
        return self

    def target(self, rows: DataFrame, surface: str, record: Column, evidence: Column, **keys: Column) -> Evidence:
        """Rows of a surface: the record that is reached, and what the link rests on."""
        self.targets.append(self._keyed(rows, keys, F.lit(surface).alias("surface"), record.cast("string").alias("record"), evidence.cast("string").alias("evidence")))
        return self

    def links(self) -> DataFrame:
        """(entity, surface, record, link_type, evidence, reasons): one row for each entity and record that meet.

        ``link_type`` is the first kind that links them, ``evidence`` the least it rests on, ``reasons`` all
        kinds in order. Anchors are made distinct before they meet; all kinds are one equi-join and
        one grouping, however many are declared. Kinds travel as numbers and reasons as bits. Rows are dealt by
        their whole key before they are grouped: hardly any are alike, so grouping them before as well would only sort them twice.
        """
        if len(self.kinds) > 63:
            raise ValueError("more than 63 kinds of evidence")
        kinds = F.array(*[F.lit(k) for k in self.kinds])
        anchors = reduce(DataFrame.unionByName, self.anchors).distinct()
        targets = reduce(DataFrame.unionByName, self.targets).repartition("record", "key", "kind", "surface")
        targets = targets.groupBy("record", "key", "kind", "surface").agg(F.min("evidence").alias("evidence"))
        rank = F.array_position(kinds, F.col("kind")).cast("int").alias("rank")
        met = anchors.join(targets, ["key", "kind"]).select("record", "entity", "surface", rank, "evidence").repartition("record", "entity", "surface")
        bit = F.expr("shiftleft(1L, rank - 1)")
        best = met.groupBy("record", "entity", "surface").agg(F.min(F.struct("rank", "evidence")).alias("why"), F.bit_or(bit).alias("all"))
        reasons = F.filter(kinds, lambda kind, i: F.getbit("all", i) == 1)
        return best.select("entity", "surface", "record", F.element_at(kinds, F.col("why.rank")).alias("link_type"), F.col("why.evidence").alias("evidence"), reasons.alias("reasons"))


def folded(name: str) -> Column:
    """A name as a key that letters' case does not change."""
    return F.lower(F.trim(name))
