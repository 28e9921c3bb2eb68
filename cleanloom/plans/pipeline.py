"""Cleaning pipelines: a list of steps from a configuration or a preset, and a report of what each changed.

Steps are lazy. Statistics and schema decisions of a step run one aggregation over what
stands before it. So that these don't start again at the source each time, the table is
kept before the first such step, and again before the next one after a costly step: with
``keep="memory"`` in executors' memory and disk, with ``keep="table"`` as Parquet in the
shared folder, which outlives lost executors. ``report`` is "none", "final" (one comparison
of the table before and after, by a join), or "full": after every step, by one aggregation of
what it makes; only steps of the user's own that may change rows cost a join.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

from cleanloom.functions.inference import BEFORE
from cleanloom.operators import steps as S
from cleanloom.plans import tables
from cleanloom.plans.report import Change, Report, change_within, compare, marked, size

Configuration = list[dict[str, dict | None]]

# The order of steps and the settings of the three presets.
PRESETS: dict[str, Configuration] = {
    "light": [
        {"enforce_schema": None},
        {"fix_columns_titles": None},
        {"handle_sentinel_values": None},
        {"safe_conversion": None},
        {"drop_constant_columns": None},
        {"fix_not_numeric_columns": None},
        {"remove_duplicates_rows": None},
        {"fix_numeric_columns": {"fixcase": "median"}},
        {"fix_bools_columns": None},
        {"fix_dates_columns": None},
        {"flag_data_quality": None},
        {"fix_columns_types": None},
        {"add_audit_columns": None},
    ],
    "default": [
        {"enforce_schema": {"min_rows": 1}},
        {"drop_high_missing_columns": {"threshold": 0.8}},
        {"drop_constant_columns": None},
        {"fix_columns_titles": None},
        {"handle_sentinel_values": None},
        {"safe_conversion": None},
        {"text_standardization": None},
        {"fix_not_numeric_columns": None},
        {"remove_duplicates_rows": None},
        {"impute_categorical": {"strategy": "mode"}},
        {"fix_numeric_columns": {"fixcase": "median"}},
        {"cap_outliers": {"lower_percentile": 0.01, "upper_percentile": 0.99}},
        {"handle_outliers": {"z_threshold": 3.0}},
        {"fix_bools_columns": None},
        {"fix_dates_columns": None},
        {"flag_data_quality": None},
        {"fix_columns_types": None},
        {"add_audit_columns": None},
    ],
    "strict": [
        {"enforce_schema": {"min_rows": 5}},
        {"drop_high_missing_columns": {"threshold": 0.5}},
        {"drop_constant_columns": None},
        {"fix_columns_titles": None},
        {"handle_sentinel_values": None},
        {"safe_conversion": None},
        {"text_standardization": None},
        {"fix_not_numeric_columns": None},
        {"remove_duplicates_rows": None},
        {"impute_categorical": {"strategy": "fixed", "fill_value": "missing"}},
        {"fix_numeric_columns": {"fixcase": "mean"}},
        {"cap_outliers": {"lower_percentile": 0.05, "upper_percentile": 0.95}},
        {"handle_outliers": {"z_threshold": 2.5}},
        {"fix_bools_columns": None},
        {"fix_dates_columns": None},
        {"flag_data_quality": None},
        {"fix_columns_types": None},
        {"add_audit_columns": None},
    ],
}
NEEDS_DATA = frozenset("SD")
#: Steps after which it pays to keep the table: cells are parsed, texts folded, rows shuffled.
COSTLY = frozenset(["safe_conversion", "text_standardization", "remove_duplicates_rows"])
TIMED = frozenset(["add_audit_columns", "fix_dates_columns", "safe_conversion"])


class Pipeline:
    def __init__(self, steps: list[Callable[[DataFrame], DataFrame]], report: str = "none", keep: str | None = None):
        if report not in ("none", "final", "full"):
            raise ValueError("report is none, final or full")
        if keep not in (None, "memory", "table"):
            raise ValueError("keep is None, memory or table")
        self.steps, self.mode, self.keep, self.report = steps, report, keep, Report()
        self._kept: list[DataFrame | str] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.keep == "table":
            df, path = tables.written(df, "step")
            self._kept.append(path)
        elif self.keep == "memory":
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
        return df

    def release(self, spark: SparkSession) -> None:
        """Free the kept tables, once the result is written or no longer needed."""
        for x in self._kept:
            x.unpersist() if isinstance(x, DataFrame) else tables.remove(spark, x)
        self._kept = []

    def run(self, df: DataFrame) -> DataFrame:
        """The cleaned table, without the internal row id."""
        first = df = S.with_row_id(S.nan_as_null(df))
        begun, due, known = time.time(), self.keep is not None, None
        for step in self.steps:
            label = type(step).__name__ if isinstance(step, S.Step) else getattr(step, "__name__", type(step).__name__)
            start, before = time.time(), df
            if due and getattr(step, "kind", "") in NEEDS_DATA:
                before = df = self._keep(df)
                due = False
            # a step that keeps the rows takes the cells before it along; one that drops rows leaves the cells of the others
            kind = getattr(step, "kind", "") if self.mode == "full" and isinstance(step, S.Step) else ""
            within = kind != "" and kind != "R"
            try:
                df = step(marked(df) if within else df)
            except Exception as e:
                raise RuntimeError(f"Error in step '{label}': {e}") from e
            due = due or (self.keep is not None and getattr(step, "name", "") in COSTLY)
            if within:
                if due:  # what a costly step made is kept at once, for the comparison too
                    df, due = self._keep(df), False
                change, known = change_within(df)
                df = df.drop(BEFORE)
            elif kind == "R":
                old, known = known or size(before), size(df)
                change = Change(old[0] - known[0], old[1], known[1], {c: 0.0 for c in S.user_columns(before) if c in df.columns})
            elif self.mode == "full":
                change, known = compare(before, df), None
            if self.mode == "full":
                self.report.add(label, replace(change, elapsed_ms=(time.time() - start) * 1000))
        if self.mode == "final":
            self.report.add("Pipeline", replace(compare(first, df), elapsed_ms=(time.time() - begun) * 1000))
        return df.drop(S.ROW_ID)


def build(configuration: Configuration | None = None, now: Column | None = None, **options) -> Pipeline:
    """A pipeline of the steps of ``configuration``, by default the preset ``default``.

    ``now`` replaces the clock of the steps that use it.
    """
    made = []
    for entry in PRESETS["default"] if configuration is None else configuration:
        for name, kwargs in entry.items():
            clock = {"now": now} if now is not None and name in TIMED else {}
            made.append(S.create(name, **clock, **(kwargs or {})))
    return Pipeline(made, **options)


def from_preset(preset: str = "default", now: Column | None = None, **options) -> Pipeline:
    """A preset by name; a name that isn't one is the default."""
    return build(PRESETS.get(preset, PRESETS["default"]), now, **options)
