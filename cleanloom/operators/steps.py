"""Cleaning steps: registered table-to-table transformations.

A step is built from keyword arguments and called with a DataFrame. ``kind`` says what it
needs: E expressions only, M names and metadata, S statistics of the data, D a decision on
the schema (both by one aggregation for all columns), R rows change. The internal row id is
no column to any of them.
"""

from __future__ import annotations

import bisect
import itertools
import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import exprs as X
from cleanloom.functions import inference as I
from cleanloom.functions.inference import HIDDEN, ROW_ID, ref, user_columns

REGISTRY: dict[str, type[Step]] = {}
FEW_PARTITIONS = 1000
#: Of approximate quantiles, and values that are counted one by one around an exact one.
ACCURACY, FEW_VALUES = 10_000, 100_000


class Step:
    name, kind = "", "E"

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def register(name: str, step: type[Step] | Callable[..., Callable[[DataFrame], DataFrame]]) -> None:
    """Add a step, or any callable that takes keyword arguments and returns a transformation."""
    REGISTRY[name] = step


def create(name: str, **kwargs) -> Callable[[DataFrame], DataFrame]:
    if name not in REGISTRY:
        raise ValueError(f"unknown step {name!r}; registered: {sorted(REGISTRY)}")
    return REGISTRY[name](**kwargs)


def _step(name: str, kind: str):
    def add(cls: type[Step]) -> type[Step]:
        cls.name, cls.kind = name, kind
        register(name, cls)
        return cls

    return add


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with some columns computed anew, in one projection."""
    return df.select(*(new[c].alias(c) if c in new else ref(c) for c in df.columns)) if new else df


def present(df: DataFrame, columns: list[str] | None, default: Callable[[], list[str]]) -> list[str]:
    return default() if columns is None else [c for c in columns if c in df.columns]


def as_number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return X.plain_number(X.blank_trimmed(ref(c)))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(ref(c).cast("double"), F.lit(None))
    return ref(c).cast("double") if I.is_numeric(kind) or isinstance(kind, T.BooleanType) else F.lit(None).cast("double")


def quantiles(df: DataFrame, columns: list[Column], shares: list[float], accuracy: int | None = None) -> list[list[float] | None]:
    """Interpolated quantiles of each column, null for a column without values; with ``accuracy`` approximate ones, in one pass.

    NaN is null. Exact ones are found in two passes or a few. Approximate quantiles a little
    to either side bracket each rank, all values of few rows do; where a bracket holds more
    than its part of FEW_VALUES rows, approximate quantiles inside it narrow it. Then the
    rows below each bracket and the values inside, each with its number, are counted with
    map-side combine, once for all shares of a column that have the same bracket. No task
    holds a column's values, and the driver FEW_VALUES at most, whatever the number of columns
    (values in a bracket of one value apart).
    """
    x = [F.col(f"x{k}") for k in range(len(columns))]
    table = df.select(*(F.nanvl(c.cast("double"), F.lit(None)).alias(f"x{k}") for k, c in enumerate(columns)))
    if accuracy is not None:
        row = table.agg(*(F.percentile_approx(c, [float(s) for s in shares], accuracy).alias(f"q{k}") for k, c in enumerate(x))).head()
        return [None if q is None else [float(v) for v in q] for q in row]
    few = max(1, FEW_VALUES // max(1, len(columns) * len(shares)))
    near = 2 / ACCURACY
    around = [p for s in shares for p in (max(0.0, s - near), min(1.0, s + near))]
    row = table.agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(c, around, ACCURACY).alias("q")).alias(f"a{k}") for k, c in enumerate(x))).head()
    size = [r["n"] for r in row]
    ranks = {(k, j): (math.floor(s * (n - 1)), math.ceil(s * (n - 1))) for k, n in enumerate(size) if n for j, s in enumerate(shares)}
    bracket = {(k, j): (row[k]["q"][2 * j], row[k]["q"][2 * j + 1]) if size[k] > few else (-math.inf, math.inf) for k, j in ranks}
    expected = {k: 4 * size[k[0]] / ACCURACY for k in ranks}
    while wide := [k for k in ranks if expected[k] > few and bracket[k][0] < bracket[k][1]]:
        held = {k: x[k[0]].between(*map(F.lit, bracket[k])) for k in wide}
        found = table.agg(*(F.struct(F.count_if(x[k[0]] < bracket[k][0]), F.count_if(held[k])).alias(f"b{i}") for i, k in enumerate(wide))).head()
        asked = []
        for k, (below, inside) in zip(wide, found, strict=True):
            low, high = ((r - below) / inside for r in ranks[k])
            asked.append(F.percentile_approx(F.when(held[k], x[k[0]]), [max(0.0, low - near), min(1.0, high + near)], ACCURACY).alias(f"q{len(asked)}"))
            expected[k] = 4 * inside / ACCURACY
        for k, q in zip(wide, table.agg(*asked).head(), strict=True):
            bracket[k] = (q[0], q[1])
    once = {(k, *held): i for i, (k, held) in enumerate(sorted({(k, held) for (k, _), held in bracket.items()}))}
    each = [F.struct(F.lit(i).alias("i"), F.when(x[k] < low, float("-inf")).when(x[k] <= high, x[k]).alias("v")) for (k, low, high), i in once.items()]
    counted: dict[int, list[tuple[float, int]]] = {}
    if each:
        for r in table.select(F.inline(F.array(*each))).where("v IS NOT NULL").groupBy("i", "v").count().collect():  # few values of each bracket
            counted.setdefault(r["i"], []).append((r["v"], r["count"]))
    summed = {i: (values := sorted(pairs), list(itertools.accumulate(n for _, n in values))) for i, pairs in counted.items()}
    out: list[list[float] | None] = [[] if n else None for n in size]
    for (k, j), held in bracket.items():
        values, upto = summed[once[k, *held]]
        a, b = (values[bisect.bisect_right(upto, r)][0] for r in ranks[k, j])
        out[k].append(a + (b - a) * (shares[j] * (size[k] - 1) - ranks[k, j][0]))
    return out


def modes(df: DataFrame, columns: dict[str, Column]) -> dict[str, object]:
    """The most frequent value of each column, the least on a tie, by one job; null if all are null.

    Counts are taken by value, so no column's values meet in one task.
    """
    if not columns:
        return {}
    long = df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns.values()))).unpivot([], [f"c{k}" for k in range(len(columns))], "k", "v")
    counts = long.where("v IS NOT NULL").groupBy("k", "v").count()
    top = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
    found = {r["k"]: r["v"] for r in top.collect()}  # a row for each column
    return {c: found.get(f"c{k}") for k, c in enumerate(columns)}


@_step("fix_columns_titles", "M")
class Titles(Step):
    """Names in lower case, blanks as underscores; equal names get a number."""

    def __call__(self, df: DataFrame) -> DataFrame:
        taken: set[str] = set()
        names = []
        for c in df.columns:
            name = base = c if c in HIDDEN else X.snake_name(c)
            k = 0
            while name in taken:
                k += 1
                name = f"{base}_{k}"
            taken.add(name)
            names.append(name)
        return df.toDF(*names)


@_step("handle_sentinel_values", "E")
class Sentinels(Step):
    """Texts that stand for missing values become null; extras are compared as given."""

    def __init__(self, extra_sentinels: list[str] | None = None):
        self.values = [*X.SENTINELS, *(str(x) for x in extra_sentinels or [])]
        self.extra = bool(extra_sentinels)

    def __call__(self, df: DataFrame) -> DataFrame:
        text = set(I.strings(df))
        typed = [c for c in user_columns(df) if c in text or (self.extra and not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)))]
        return replaced(df, {c: F.when(~F.coalesce(X.key(ref(c)).isin(*self.values), F.lit(False)), ref(c)) for c in typed})


@_step("normalize_categories", "E")
class Categories(Step):
    """Variants to one spelling; what isn't listed stays, trimmed and in lower case. Null becomes ``nan``."""

    def __init__(self, mappings: dict[str, dict[str, str]], keep_null: bool = False):
        self.mappings, self.keep_null = mappings, keep_null

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, mapping in self.mappings.items():
            if c in df.columns and mapping:
                k = X.key(ref(c))
                k = k if self.keep_null else F.coalesce(k, F.lit("nan"))
                pairs = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
                new[c] = F.coalesce(F.try_element_at(pairs, k), k)
        return replaced(df, new)


@_step("safe_conversion", "D")
class SafeConversion(Step):
    """Number words, amounts and dates in text columns.

    A column whose filled cells are all numbers becomes double, one of dates only a
    timestamp; any other stays text, with the cells that convert printed anew.
    """

    def __init__(self, columns: list[str] | None = None, digit_threshold: float = 0.3, now: Column | None = None):
        self.columns, self.threshold, self.now = columns, digit_threshold, now

    def __call__(self, df: DataFrame) -> DataFrame:
        text, now = I.strings(df), F.localtimestamp() if self.now is None else self.now
        asked = text if self.columns is None else [c for c in self.columns if c in text]
        found = I.profiles(df, asked, now, ("n", "filled", "digits", "numbers", "dates"))
        new = {}
        for c, p in found.items():
            if self.columns is None and not (p.n and p.digits / p.n > self.threshold):
                continue
            number, date = X.number(ref(c)), X.date_cell(ref(c), now)
            if p.filled and p.numbers == p.filled:
                new[c] = number
            elif p.filled and p.dates == p.filled:
                new[c] = date
            else:
                new[c] = F.coalesce(X.float_text(number), X.date_text(date), ref(c))
        return replaced(df, new)


@_step("fix_not_numeric_columns", "D")
class TextColumns(Step):
    """Trimmed, lower case, blanks as underscores; ``nan`` is null."""

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in present(df, self.columns, lambda: I.categorical_columns(df)):
            done = X.snake(ref(c))
            new[c] = F.when(done != "nan", done)
        return replaced(df, new)


@_step("remove_duplicates_rows", "R")
class Duplicates(Step):
    """Equal rows once, nulls equal to each other; of each the first by row id."""

    def __call__(self, df: DataFrame) -> DataFrame:
        columns = user_columns(df)
        if ROW_ID not in df.columns:
            return df.dropDuplicates(columns)
        if not columns:
            return df
        # rows are groups already: least row id with map-side combine, and no wide sort
        once = df.groupBy(*(ref(c) for c in columns)).agg(F.min(ROW_ID).alias(ROW_ID))
        return once.select(*(ref(c) for c in df.columns))


@_step("validate_domain_rules", "E")
class DomainRules(Step):
    """Numbers outside [low, high] become null; a missing side is open, text that is no number stays."""

    def __init__(self, rules: dict[str, list]):
        self.rules = rules

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, bounds in self.rules.items():
            if c in df.columns:
                n, (low, high) = as_number(df, c), (*bounds, None, None)[:2]
                out = F.lit(False)
                out = out if low is None else out | (n < low)
                out = out if high is None else out | (n > high)
                new[c] = F.when(F.coalesce(out, F.lit(False)), None).otherwise(ref(c))
        return replaced(df, new)


@_step("fix_numeric_columns", "S")
class NumericColumns(Step):
    """Numbers from text, then the mean, median or mode for nulls."""

    def __init__(self, fixcase: str = "median", columns: list[str] | None = None, accuracy: int | None = None):
        if fixcase not in ("mean", "median", "mode"):
            raise ValueError(f"unknown fixcase {fixcase!r}: use mean, median or mode")
        self.fixcase, self.columns, self.accuracy = fixcase, columns, accuracy

    def __call__(self, df: DataFrame) -> DataFrame:
        target = present(df, self.columns, lambda: I.numeric_columns(df))
        if not target:
            return df
        value = {c: X.scrubbed_number(ref(c)) if c in I.strings(df) else as_number(df, c) for c in target}
        if self.fixcase == "mode":
            fill = modes(df, value)
        else:
            if self.fixcase == "mean":
                row = df.agg(*(F.avg(x).alias(f"s{k}") for k, x in enumerate(value.values()))).head()
            else:
                row = [None if q is None else q[0] for q in quantiles(df, list(value.values()), [0.5], self.accuracy)]
            fill = dict(zip(value, row, strict=True))
        return replaced(df, {c: F.coalesce(x, F.lit(fill[c]).cast("double")) for c, x in value.items()})


@_step("handle_outliers", "S")
class Outliers(Step):
    """Clip to 1.5 interquartile ranges beyond the quartiles, then null what is over z_threshold deviations off."""

    def __init__(self, columns: list[str] | None = None, z_threshold: float = 3.0, accuracy: int | None = None):
        self.columns, self.z, self.accuracy = columns, z_threshold, accuracy

    def __call__(self, df: DataFrame) -> DataFrame:
        target = present(df, self.columns, lambda: I.numbers(df))
        target = [c for c in target if c in I.numbers(df)]
        if not target:
            return df
        value = {c: as_number(df, c) for c in target}
        quarts = quantiles(df, list(value.values()), [0.25, 0.75], self.accuracy)
        clip = {}
        for (c, x), q in zip(value.items(), quarts, strict=True):
            low, high = (None, None) if q is None else (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))
            clip[c] = x if q is None else X.clipped(x, F.lit(low), F.lit(high))
        stats = df.agg(*(F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias(f"z{k}") for k, x in enumerate(clip.values()))).head()
        new = {}
        for (c, x), z in zip(clip.items(), stats, strict=True):
            spread = z["n"] > 3 and z["s"] is not None and z["s"] > 0
            new[c] = F.when(F.abs((x - z["m"]) / z["s"]) <= self.z, x) if spread else x
        return replaced(df, new)


@_step("fix_bools_columns", "D")
class Bools(Step):
    """Truth words to booleans. Null becomes true, as ``null_as`` says."""

    def __init__(self, columns: list[str] | None = None, null_as: bool | None = True):
        self.columns, self.null_as = columns, null_as

    def __call__(self, df: DataFrame) -> DataFrame:
        text = set(I.strings(df))
        new = {}
        for c in present(df, self.columns, lambda: I.bool_columns(df)):
            value = X.truth(ref(c)) if c in text else as_number(df, c) != 0
            new[c] = value if self.null_as is None else F.coalesce(value, F.lit(self.null_as))
        return replaced(df, new)


@_step("fix_dates_columns", "D")
class Dates(Step):
    """Dates from text; null before 1900, after now and where nothing reads."""

    def __init__(self, columns: list[str] | None = None, now: Column | None = None):
        self.columns, self.now = columns, now

    def __call__(self, df: DataFrame) -> DataFrame:
        now = F.localtimestamp() if self.now is None else self.now
        text = set(I.strings(df))
        target = present(df, self.columns, lambda: I.date_columns(df, now))
        return replaced(df, {c: X.within(X.any_date(ref(c)) if c in text else ref(c).cast("timestamp_ntz"), now) for c in target})


@_step("cross_column_validation", "E")
class CrossColumns(Step):
    """Where if_col equals a value and then_col is null, if_col becomes null. Rules apply one after another."""

    def __init__(self, rules: list[dict]):
        self.rules = [r for r in rules if r.get("action", "set_nan") == "set_nan"]

    def __call__(self, df: DataFrame) -> DataFrame:
        for r in self.rules:
            i, t = r["if_col"], r["then_col"]
            if i in df.columns and t in df.columns:
                df = replaced(df, {i: F.when(~((ref(i) == F.lit(r["equals"])) & ref(t).isNull()) | ref(i).isNull(), ref(i))})
        return df


@_step("flag_data_quality", "E")
class Quality(Step):
    """_quality_score: one less the share of the row's columns that are null."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_quality_score", 1 - X.null_share(user_columns(df)))


@_step("fix_columns_types", "E")
class Types(Step):
    """Final casts of listed columns; what can't be cast is null, but null truth is true."""

    def __init__(self, numeric_columns: list[str] | None = None, bool_columns: list[str] | None = None, date_columns: list[str] | None = None):
        self.number, self.bool, self.date = numeric_columns or [], bool_columns or [], date_columns or []

    def __call__(self, df: DataFrame) -> DataFrame:
        text = set(I.strings(df))
        new = {c: as_number(df, c) for c in self.number if c in df.columns}
        for c in self.bool:
            if c in df.columns:
                new[c] = F.coalesce(ref(c) != "" if c in text else as_number(df, c) != 0, F.lit(True))
        new |= {c: X.any_date(ref(c)) if c in text else ref(c).cast("timestamp_ntz") for c in self.date if c in df.columns}
        return replaced(df, new)


@_step("drop_high_missing_columns", "D")
class HighMissing(Step):
    def __init__(self, threshold: float = 0.8):
        self.threshold = threshold

    def __call__(self, df: DataFrame) -> DataFrame:
        columns = user_columns(df)
        if not columns:
            return df
        row = df.agg(*(F.avg(ref(c).isNull().cast("double")).alias(f"m{k}") for k, c in enumerate(columns))).head()
        return df.drop(*(c for c, m in zip(columns, row, strict=True) if m is not None and m > self.threshold))


@_step("drop_constant_columns", "D")
class Constant(Step):
    """Columns with one value or none go; columns whose type has no order stay."""

    def __call__(self, df: DataFrame) -> DataFrame:
        columns = [c for c in user_columns(df) if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
        if not columns:
            return df
        row = df.agg(*(F.coalesce(F.min(ref(c)) == F.max(ref(c)), F.lit(True)).alias(f"k{k}") for k, c in enumerate(columns))).head()
        return df.drop(*(c for c, same in zip(columns, row, strict=True) if same))


@_step("text_standardization", "E")
class TextStandard(Step):
    """Accents and signs off, blanks single, lower case. ``fold`` may be exprs.fold_ascii_any."""

    def __init__(self, columns: list[str] | None = None, fold: Callable[[Column], Column] = X.fold_ascii):
        self.columns, self.fold = columns, fold

    def __call__(self, df: DataFrame) -> DataFrame:
        target = I.strings(df) if self.columns is None else self.columns
        if lost := [c for c in target if c not in df.columns]:
            raise KeyError(f"no such columns: {lost}")
        return replaced(df, {c: X.standard_text(ref(c).cast("string"), self.fold) for c in target})


@_step("cap_outliers", "S")
class Caps(Step):
    """Values beyond two quantiles become the quantile."""

    def __init__(self, columns: list[str] | None = None, lower_percentile: float = 0.01, upper_percentile: float = 0.99, accuracy: int | None = None):
        self.columns, self.shares, self.accuracy = columns, [lower_percentile, upper_percentile], accuracy

    def __call__(self, df: DataFrame) -> DataFrame:
        target = I.numbers(df) if self.columns is None else self.columns
        if lost := [c for c in target if c not in df.columns]:
            raise KeyError(f"no such columns: {lost}")
        if not target:
            return df
        value = {c: as_number(df, c) for c in target}
        row = quantiles(df, list(value.values()), self.shares, self.accuracy)
        return replaced(df, {c: x if q is None else X.clipped(x, F.lit(q[0]), F.lit(q[1])) for (c, x), q in zip(value.items(), row, strict=True)})


@_step("impute_categorical", "S")
class Impute(Step):
    """Null text becomes the column's mode, or with any other strategy a fixed label."""

    def __init__(self, columns: list[str] | None = None, strategy: str = "mode", fill_value: str = "unknown"):
        self.columns, self.strategy, self.fill = columns, strategy, fill_value

    def __call__(self, df: DataFrame) -> DataFrame:
        target = present(df, self.columns, lambda: I.strings(df))
        fill = modes(df, {c: ref(c) for c in target}) if self.strategy == "mode" else dict.fromkeys(target, self.fill)
        return replaced(df, {c: F.coalesce(ref(c), F.lit(fill[c])) for c in target if fill[c] is not None})


@_step("enforce_schema", "M")
class Schema(Step):
    """Warns of missing columns and too few rows; the table passes as it is."""

    def __init__(self, required_columns: list[str] | None = None, min_rows: int = 1):
        self.required, self.min_rows = required_columns or [], min_rows

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.min_rows > 0 and (n := df.limit(self.min_rows).count()) < self.min_rows:
            warnings.warn(f"the table has {n} rows, fewer than {self.min_rows}", stacklevel=2)
        if lost := [c for c in self.required if c not in df.columns]:
            warnings.warn(f"the table lacks the columns {lost}", stacklevel=2)
        return df


@_step("add_audit_columns", "E")
class Audit(Step):
    """_original_index, the place of the row at reading, and _cleaned_at, one time for all rows."""

    def __init__(self, now: Column | None = None):
        self.now = now

    def __call__(self, df: DataFrame) -> DataFrame:
        now = F.localtimestamp() if self.now is None else self.now
        if "_original_index" not in df.columns:
            df = df.withColumn("_original_index", F.col(ROW_ID)) if ROW_ID in df.columns else with_places(df, "_original_index")
        return df.withColumn("_cleaned_at", now)


def with_places(df: DataFrame, name: str) -> DataFrame:
    """A row's place among all rows, without a sort: rows of the partitions before, and its own place there.

    The starts of the partitions, a number each, are a literal while they are few and a
    broadcast table beyond that.
    """
    sizes = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    return numbered(df, name, F.monotonically_increasing_id(), sizes)


def numbered(df: DataFrame, name: str, own: Column, sizes: dict[int, int]) -> DataFrame:
    """``df`` with dense places, of monotonically increasing ids and the number of rows of each part."""
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    if len(before) <= FEW_PARTITIONS:
        start = F.array(*(F.lit(b).cast("long") for b in before))
        return df.withColumn(name, start[F.shiftright(own, 33).cast("int")] + own.bitwiseAND((1 << 33) - 1))
    starts = df.sparkSession.createDataFrame(list(enumerate(before)), "_part int, _start long")
    placed = df.withColumn(name, own).withColumn("_part", F.shiftright(name, 33).cast("int")).join(F.broadcast(starts), "_part")
    own = F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1)
    return placed.select(*(ref(c) for c in df.columns if c != name), own.alias(name))


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` with the internal row id, unless it has one."""
    return df if ROW_ID in df.columns else with_places(df, ROW_ID)


def nan_as_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return replaced(df, {c: F.nanvl(ref(c), F.lit(None)) for c in floats})


