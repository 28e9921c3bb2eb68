"""What a column holds, found from its values: one aggregation for all columns at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import exprs as X

#: Columns that are no columns to any step: the place at reading, and the cells before a step that is reported on.
ROW_ID, BEFORE = "_row_id", "_before"
HIDDEN = (ROW_ID, BEFORE)
NUMERIC_SHARE, DATE_SHARE, DATE_SAMPLE = 0.7, 0.5, 10
FIRST_ROWS = 1000


def ref(name: str) -> Column:
    return F.col(f"`{name}`")


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != ROW_ID]


def numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name != ROW_ID]


@dataclass(frozen=True)
class Profile:
    """Counts for one string column."""

    n: int
    filled: int
    digits: int
    numeric_like: int
    truths: int
    numbers: int
    dates: int

    @property
    def numeric(self) -> bool:
        return self.filled > 0 and self.numeric_like / self.filled > NUMERIC_SHARE

    @property
    def boolean(self) -> bool:
        return self.filled > 0 and self.truths == self.filled


FIELDS = ("n", "filled", "digits", "numeric_like", "truths", "numbers", "dates")


def _counts(c: Column, now: Column, fields: tuple[str, ...]) -> list[Column]:
    number = X.number(c)
    tests = {
        "n": F.lit(True), "filled": c.isNotNull(), "digits": c.rlike(r"[\d$€£]"), "numeric_like": X.looks_numeric(c),
        "truths": X.key(c).isin(*X.TRUE_WORDS, *X.FALSE_WORDS), "numbers": number.isNotNull(),
        "dates": number.isNull() & X.date_cell(c, now).isNotNull(),
    }
    return [F.count_if(tests[f]) if f in fields else F.lit(0) for f in FIELDS]


def profiles(df: DataFrame, columns: list[str] | None = None, now: Column | None = None, fields: tuple[str, ...] = FIELDS) -> dict[str, Profile]:
    """Profiles of string columns, by one job over all of them; only ``fields`` are counted."""
    columns = strings(df) if columns is None else columns
    if not columns:
        return {}
    now = F.localtimestamp() if now is None else now
    row = df.agg(*(F.struct(*(x.alias(f) for x, f in zip(_counts(ref(c), now, fields), FIELDS, strict=True))).alias(f"p{k}") for k, c in enumerate(columns))).head()
    return {c: Profile(*row[k]) for k, c in enumerate(columns)}


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns, and text columns of which over 70 % of the filled cells look like numbers."""
    found = profiles(df, fields=("filled", "numeric_like"))
    return [c for c in user_columns(df) if c in numbers(df) or (c in found and found[c].numeric)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, p in profiles(df, fields=("filled", "numeric_like")).items() if not p.numeric]


def bool_columns(df: DataFrame) -> list[str]:
    """Truth columns, and text columns of truth words only."""
    found = profiles(df, fields=("filled", "truths"))
    typed = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    return [c for c in user_columns(df) if c in typed or (c in found and found[c].boolean)]


def date_columns(df: DataFrame, now: Column | None = None) -> list[str]:
    """Date columns, and text columns of whose first ten filled cells at least half are dates.

    The first cells are the first by row id.
    """
    text = strings(df)
    typed = [f.name for f in df.schema if is_date(f.dataType)]
    if not text:
        return typed
    now = F.localtimestamp() if now is None else now
    frame = df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
    # the first cells of all columns mostly stand in the first rows: one job finds these
    first = frame.select(ROW_ID, *(ref(c).alias(f"c{k}") for k, c in enumerate(text))).orderBy(ROW_ID).limit(FIRST_ROWS)
    hit = lambda c: X.within(X.any_date(c), now).isNotNull()
    cells = [
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"c{k}").isNotNull(), F.struct(F.col(ROW_ID).alias("at"), hit(F.col(f"c{k}")).alias("hit"))))), lambda x: x["hit"]), 1, DATE_SAMPLE).alias(f"h{k}")
        for k in range(len(text))
    ]
    row = first.agg(F.count("*").alias("n"), *cells).head()
    hits = {}
    for k, c in enumerate(text):
        found = row[f"h{k}"]
        if len(found) < DATE_SAMPLE and row["n"] == FIRST_ROWS:  # further down: a task passes on ten cells
            rest = frame.select(ROW_ID, ref(c).alias("v")).where("v IS NOT NULL").orderBy(ROW_ID).limit(DATE_SAMPLE)
            found = [r["hit"] for r in rest.select(hit(F.col("v")).alias("hit")).collect()]
        hits[c] = bool(found) and sum(found) / len(found) >= DATE_SHARE
    return [c for c in user_columns(df) if c in typed or hits.get(c)]
