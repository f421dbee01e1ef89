"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Quotient as double, null where the denominator is zero or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation aggregate, null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def to_number(c: Column | str) -> Column:
    """Double, null for text that is no number and for NaN."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def to_day(c: Column | str) -> Column:
    return F.to_date(col(c).try_cast("timestamp"))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def lookup(mapping: dict, key: Column | str, default=None) -> Column:
    """Value of a small settings map for a key column."""
    out = None
    for k, v in mapping.items():
        out = F.when(col(key) == F.lit(k), F.lit(v)) if out is None else out.when(
            col(key) == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def group_code(codes: dict[str, int], key: Column | str = "grp") -> Column:
    return lookup(codes, key, -1).cast("int")


def cutoff(season: Column | str = "season") -> Column:
    """Information cutoff of a forecast season: 1 August."""
    return F.make_date(col(season).cast("int"), F.lit(8), F.lit(1))


def normalize_name(c: Column | str) -> Column:
    """Lower-case letters and blanks only, generational suffix dropped."""
    kept = F.regexp_replace(F.trim(F.lower(col(c))), "[^a-z ]+", "")
    return F.trim(F.regexp_replace(kept, r"\s+(jr|sr|ii|iii|iv|v)$", ""))


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("league")).otherwise(s)


def first_present(df: DataFrame, *names: str) -> str | None:
    """First of the names that is a column of the frame."""
    return next((n for n in names if n in df.columns), None)
