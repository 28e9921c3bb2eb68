"""What a step changed: rows, nulls, and the share of cells of each column that differ."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import inference as I
from cleanloom.functions.inference import BEFORE, ROW_ID, user_columns


def _changed(kind_b: T.DataType, b: Column, kind_a: T.DataType, a: Column) -> Column:
    """Whether a cell differs: by value among like types, and wherever there is one where a type became another."""
    plain = lambda k: I.is_numeric(k) or isinstance(k, T.BooleanType)
    if kind_b == kind_a:
        return ~b.eqNullSafe(a)
    if plain(kind_b) and plain(kind_a):
        return ~b.cast("double").eqNullSafe(a.cast("double"))
    if I.is_date(kind_b) and I.is_date(kind_a):
        return ~b.cast("timestamp_ntz").eqNullSafe(a.cast("timestamp_ntz"))
    return b.isNotNull() | a.isNotNull()


def change_ratios(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: for each common column the share of common rows (by row id) whose cell differs."""
    common = [c for c in user_columns(before) if c in user_columns(after)]
    b = before.select(ROW_ID, *(I.ref(c).alias(f"b{k}") for k, c in enumerate(common)))
    a = after.select(ROW_ID, *(I.ref(c).alias(f"a{k}") for k, c in enumerate(common)))
    share = [
        F.coalesce(F.avg(_changed(before.schema[c].dataType, F.col(f"b{k}"), after.schema[c].dataType, F.col(f"a{k}")).cast("double")), F.lit(0.0)).alias(c)
        for k, c in enumerate(common)
    ]
    return b.join(a, ROW_ID).agg(*share) if common else before.sparkSession.range(1).select()


@dataclass(frozen=True)
class Change:
    """What a step did to a table."""

    rows_removed: int = 0
    nulls_before: int = 0
    nulls_after: int = 0
    change_ratio: dict[str, float] = field(default_factory=dict)
    elapsed_ms: float = 0.0

    def metrics(self) -> dict:
        # The names and the order of the metrics in a report.
        return {
            "rows_removed": self.rows_removed, "nulls_before": self.nulls_before, "nulls_after": self.nulls_after,
            "changed_columns": list(self.change_ratio), "change_ratio": self.change_ratio, "elapsed_ms": self.elapsed_ms,
        }

    def row(self, name: str) -> tuple:
        """The line of a summary, as in SUMMARY."""
        shares = self.change_ratio.values()
        mean = round(sum(shares) / len(shares), 3) if shares else 0.0
        return name, round(self.elapsed_ms, 2), self.rows_removed, sum(x > 0 for x in shares), self.nulls_before, self.nulls_after, self.nulls_after - self.nulls_before, mean


# The columns of a summary.
SUMMARY = {
    "step": "string", "elapsed_ms": "double", "rows_removed": "long", "columns_changed": "long", "nulls_before": "long", "nulls_after": "long",
    "null_diff": "long", "avg_change": "double",
}


def _nulls(cells: list[Column]) -> Column:
    return F.coalesce(sum((F.sum(c.isNull().cast("long")) for c in cells), F.lit(0)), F.lit(0))


def size(df: DataFrame) -> tuple[int, int]:
    """Rows, and nulls in the user's columns."""
    row = df.agg(F.count("*").alias("n"), _nulls([I.ref(c) for c in user_columns(df)]).alias("nulls")).head()
    return row["n"], row["nulls"]


def compare(before: DataFrame, after: DataFrame) -> Change:
    """The change between two tables that carry the row id, by a join on it."""
    (n, nulls), (m, left) = size(before), size(after)
    ratios = change_ratios(before, after)
    shares = dict(zip(ratios.columns, ratios.head(), strict=True)) if ratios.columns else {}
    return Change(n - m, nulls, left, shares)


def marked(df: DataFrame) -> DataFrame:
    """``df`` with its own cells once more in the hidden column BEFORE, which steps that keep all rows pass on."""
    return df.withColumn(BEFORE, F.struct(*(I.ref(c).alias(c) for c in user_columns(df))))


def change_within(df: DataFrame) -> tuple[Change, tuple[int, int]]:
    """The change since ``marked``, and the size now, by one aggregation of the step's own projection: no join and no second pass."""
    kinds = {f.name: f.dataType for f in df.schema[BEFORE].dataType}
    was = {c: F.col(BEFORE).getField(c) for c in kinds}
    common = [c for c in kinds if c in user_columns(df)]
    shares = [F.coalesce(F.avg(_changed(kinds[c], was[c], df.schema[c].dataType, I.ref(c)).cast("double")), F.lit(0.0)) for c in common]
    row = df.agg(F.count("*"), _nulls(list(was.values())), _nulls([I.ref(c) for c in user_columns(df)]), *shares).head()
    return Change(0, row[1], row[2], dict(zip(common, row[3:], strict=True))), (row[0], row[2])


class Report:
    """Metrics of the steps, in order; what is added is a Change, or metrics of the caller's own."""

    def __init__(self):
        self.changes: list[tuple[str, Change | dict]] = []

    def add(self, name: str, change: Change | dict) -> None:
        self.changes.append((name, change))

    @property
    def steps(self) -> list[dict]:
        return [{"name": name, "metrics": x if isinstance(x, dict) else x.metrics()} for name, x in self.changes]

    def _lines(self) -> list[tuple]:
        known = {f.name for f in fields(Change)}
        made = ((name, x if isinstance(x, Change) else Change(**{k: v for k, v in x.items() if k in known})) for name, x in self.changes)
        return [change.row(name) for name, change in made]

    def detailed_summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._lines(), ", ".join(f"{name} {kind}" for name, kind in SUMMARY.items()))

    def summary(self, spark: SparkSession) -> DataFrame:
        return self.detailed_summary(spark).select("step", "rows_removed", "columns_changed", "avg_change")

    def lines(self) -> list[str]:
        """The summary as text, columns side by side."""
        if not self.changes:
            return ["The report has no steps."]
        table = [[str(v) for v in row] for row in (tuple(SUMMARY), *self._lines())]
        widths = [max(map(len, column)) for column in zip(*table, strict=True)]
        return ["  ".join(v.rjust(w) for v, w in zip(row, widths, strict=True)) for row in table]

    def print_summary(self) -> None:
        print("\n".join(self.lines()))

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.steps, f, indent=4)
