"""Look-ups whose keys are checked while the query itself runs.

A left join with a look-up that repeats a key multiplies rows in silence. Two ways
to see it, neither with a scan of its own: ``attach_unique`` stops the query,
``LookupAudit`` counts rows before and behind the join and reports them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scenara.operators.rollup import attach_mapping


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def unique_mapping(mapping: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``mapping`` with one row for each key; a repeated key stops the query.

    Keys with a missing part match nothing in a join, and so may repeat. The sum that
    finds repeats reads the look-up once and runs before Spark decides whether to
    broadcast it.
    """
    keys = _names(on)
    values = [c for c in mapping.columns if c not in keys]
    named = F.concat_ws(", ", *[F.col(f"`{k}`").cast("string") for k in keys])
    repeated = F.raise_error(F.concat(F.lit(f"the look-up repeats a key of {', '.join(keys)}: "), named))
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    known = mapping.dropna(subset=keys)
    rows = known.groupBy(*keys).agg(F.first(row).alias("_row"), F.count(F.lit(1)).alias("_rows"))
    checked = rows.withColumn("_row", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("_row")))
    return checked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in values])


def attach_unique(df: DataFrame, mapping: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``attach_mapping`` that stops where the look-up repeats a key."""
    return attach_mapping(df, unique_mapping(mapping, on), on)


class LookupAudit:
    """Row counts of one left look-up, known when the query that uses it has run.

    ``rows`` come in, ``joined`` go out, ``unmatched`` of them found nothing. Filters
    above the look-up are not moved below it, as the counts would change.
    """

    def __init__(self, name: str = "look-up") -> None:
        self.name = name
        self._before, self._behind = Observation(f"{name}: before"), Observation(f"{name}: behind")

    def attach(self, df: DataFrame, mapping: DataFrame, on: str | Sequence[str]) -> DataFrame:
        counted = df.observe(self._before, F.count(F.lit(1)).alias("rows"))
        joined = attach_mapping(counted, mapping.withColumn("_found", F.lit(True)), on)
        metrics = [F.count(F.lit(1)).alias("joined"), F.count_if(F.col("_found").isNull()).alias("unmatched")]
        return joined.observe(self._behind, *metrics).drop("_found")

    def report(self) -> dict[str, int]:
        """``rows``, ``joined``, ``unmatched`` and ``added``; waits for the query to end."""
        found = {**self._before.get, **self._behind.get}
        return {**found, "added": found["joined"] - found["rows"]}

    def require_unique(self) -> None:
        """Raise if the look-up multiplied rows."""
        added = self.report()["added"]
        if added:
            raise ValueError(f"{self.name}: repeated keys added {added} rows")
