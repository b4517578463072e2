"""User properties kept one table per property, (uid, val): a wide row is assembled by joining on uid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyStore:
    """tables: property name to a DataFrame of uid and val. A user without a property has no row in its table."""

    tables: Mapping[str, DataFrame]

    def one(self, name: str, condition: Column | None = None) -> DataFrame:
        """(uid, <name>) of a property. condition: on the column named as the property."""
        if name not in self.tables:
            raise KeyError(f"no property {name}; there are {', '.join(sorted(self.tables))}")
        rows = self.tables[name].select("uid", F.col("val").alias(name))
        return rows if condition is None else rows.where(condition)

    def wide(self, names: Sequence[str], conditions: Mapping[str, Column] | None = None, how: str = "inner") -> DataFrame:
        """uid and all the properties named. Conditions reach each property's own scan before the joins."""
        conditions = conditions or {}
        if not names:
            return self.users()
        return reduce(lambda a, b: a.join(b, "uid", how), [self.one(n, conditions.get(n)) for n in names])

    def users(self) -> DataFrame:
        """Every user with any property."""
        return reduce(lambda a, b: a.union(b), [t.select("uid") for t in self.tables.values()]).distinct()


def pivoted(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same from one long table (uid, property, val): one aggregation however many properties; absent ones are null."""
    value = lambda n: F.max(F.when(F.col("property") == n, F.col("val"))).alias(n)
    return long.where(F.col("property").isin(list(names))).groupBy("uid").agg(*map(value, names))
