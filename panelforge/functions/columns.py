"""Column helpers: coercion, schema by convention, symbols, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_available(df: DataFrame, canonical: list[str]) -> DataFrame:
    """The canonical columns that exist, in canonical order."""
    return df.select([c for c in canonical if c in df.columns])


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rename the first existing candidate of each name; a missing required one is an error."""
    found = {name: next((c for c in names if c in df.columns), None) for name, names in aliases.items()}
    missing = [n for n, c in found.items() if c is None and n not in optional]
    if missing:
        raise ValueError(f"no column for: {', '.join(missing)}")
    return df.select([F.col(c).alias(n) for n, c in found.items() if c is not None])


def detect_format(columns: list[str]) -> str:
    """cashtag style (symbols or a native label) or forum style (title or subreddit)."""
    names = {c.lower() for c in columns}
    if names & {"symbols", "symbol_list", "sentiment", "entities"} and names & {"body", "message", "text"}:
        return "stocktwits"
    if names & {"title", "selftext", "subreddit"}:
        return "reddit"
    raise ValueError("unknown message format")


def number(c: Column, default: float | None = None) -> Column:
    """Numeric coercion that never fails; blanks and garbage become the default."""
    value = c.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(default))


def flag(condition: Column) -> Column:
    """0/1 with unknown as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def at_least(c: Column, low: float) -> Column:
    return F.greatest(c, F.lit(low))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def normalise_ticker(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))


def to_slash(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("/"))


def from_slash(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("-"))


def clean_symbols(symbols: Column) -> Column:
    """Strip $ and blanks, keep well-formed symbols, sorted and distinct."""
    stripped = F.transform(symbols, lambda s: F.upper(F.ltrim(F.trim(s), F.lit("$"))))
    return F.array_sort(F.array_distinct(F.filter(stripped, lambda s: s.rlike(r"^[A-Z][A-Z0-9-]*$"))))


def month_of(c: Column) -> Column:
    return F.date_format(F.trunc(c, "MM"), "yyyy-MM")


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_time(c: Column) -> Column:
    """Epoch seconds or a timestamp text; errors become null."""
    seconds = c.cast("string").try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(c.cast("string")))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def human_bytes(n: float) -> str:
    """1.5 KB style, in powers of 1024."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def human_money(c: Column) -> Column:
    """$1.2B, $3.4M, $56K or $7: the largest unit that fits."""
    size = F.abs(c)
    text = lambda by, unit: F.concat(F.lit("$"), F.format_string("%.1f", c / by), F.lit(unit))
    return F.when(size >= 1e9, text(1e9, "B")).when(size >= 1e6, text(1e6, "M")).when(size >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", c / 1e3), F.lit("K"))).otherwise(F.concat(F.lit("$"), F.format_string("%.0f", c)))


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%+.{digits}f", c * 100), F.lit("%"))


def clock_text(iso: Column) -> Column:
    """HH:MM of an ISO time text; a dash where there is none."""
    found = F.regexp_extract(iso, r"T(\d{2}:\d{2})", 1)
    return F.when(iso.isNull() | (found == ""), "-").otherwise(found)


def day_change(equity: Column, last: Column) -> Column:
    """Relative change since the last close; 0 without a positive last value."""
    return F.when(last > 0, equity / last - 1).otherwise(0.0)


def time_or_now(c: Column) -> Column:
    """A parsed time, or the current one where it does not parse."""
    return F.coalesce(parse_time(c), F.current_timestamp())


def staleness_band(minutes: Column) -> Column:
    """Age of the last run: fresh to 35 minutes, late to 120, then stale; never without a run."""
    return F.when(minutes.isNull(), "never").when(minutes <= 35, "fresh").when(minutes <= 120, "late").otherwise("stale")


def without_number(c: Column) -> Column:
    """No number in it: how rows without a native label are told."""
    return c.cast("string").try_cast("double").isNull()
