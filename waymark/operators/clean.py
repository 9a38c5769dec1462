"""Cleaning of raw text records. Column functions; clean_rows puts them together in one projection that drops no row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity texts, coordinate bounds and statuses.
SEVERITY = {"FATAL": "K", "INCAPACITATING INJURY": "A", "NONINCAPACITATING INJURY": "B", "REPORTED, NOT EVIDENT": "C", "NO INDICATION OF INJURY": "O"}
UNKNOWN = "U"
BOUNDS = (41.0, 43.0, -89.0, -87.0)


BLANKS = " \t\n\r\x0b\x0c"
#: Date formats beside ISO 8601, tried in this order.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_string(c: Column, upper: bool = False) -> Column:
    """Trim all white space; empty becomes null."""
    t = F.nullif(strip(c), F.lit(""))
    return F.upper(t) if upper else t


def coerce_float(c: Column) -> Column:
    return normalize_string(c).try_cast("double")


def invalid_float(c: Column) -> Column:
    return normalize_string(c).isNotNull() & coerce_float(c).isNull()


def coerce_integer(c: Column) -> Column:
    """Whole numbers, also written as 7.0; others are null."""
    d = coerce_float(c)
    return F.when(d % 1 == 0, d.cast("long"))


def invalid_integer(c: Column) -> Column:
    return normalize_string(c).isNotNull() & coerce_integer(c).isNull()


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date of a text in ISO 8601 (with or without a time) or one of the formats; null for any other text."""
    t = normalize_string(c)
    iso = F.when(t.rlike(r"^\d{4}-"), t.try_cast("date"))
    return F.when(t.isNull() | iso.isNotNull(), iso).otherwise(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date"))


def map_severity(c: Column, codes: dict[str, str] | None = None, unknown: str = UNKNOWN) -> Column:
    """The code of a text; codes: by upper-case text."""
    known = F.create_map(*[F.lit(x) for kv in (SEVERITY if codes is None else codes).items() for x in kv])
    return F.coalesce(F.try_element_at(known, normalize_string(c, upper=True)), F.lit(unknown))


def severity_unmapped(c: Column, codes: dict[str, str] | None = None) -> Column:
    return normalize_string(c).isNotNull() & ~F.coalesce(normalize_string(c, upper=True).isin(*(SEVERITY if codes is None else codes)), F.lit(False))


def classify_coordinates(lat: Column, lon: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    return _coordinate_status(normalize_string(lat), normalize_string(lon), coerce_float(lat), coerce_float(lon), bounds)


def _coordinate_status(a: Column, o: Column, x: Column, y: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    return (
        F.when(a.isNull() & o.isNull(), "missing_pair").when(a.isNull() | o.isNull(), "incomplete_pair").when(x.isNull() | y.isNull(), "non_numeric")
        .when(~x.between(bounds[0], bounds[1]) | ~y.between(bounds[2], bounds[3]), "out_of_range").otherwise("valid")
    )


def outside_domain(c: Column, allowed: tuple[str, ...] = ("Y", "N")) -> Column:
    t = normalize_string(c, upper=True)
    return t.isNotNull() & ~F.coalesce(t.isin(*allowed), F.lit(False))


def outside_range(c: Column, low: float, high: float, missing_allowed: bool = True) -> Column:
    out = F.coalesce(~c.between(low, high), F.lit(False))
    return out if missing_allowed else out | c.isNull()


def normalize_street(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), F.lit(""))


def with_aliases(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """out: the canonical name where aliases (alias, canonical) has one; aliases is a small contract table."""
    return df.join(F.broadcast(aliases), F.col(name) == F.col("alias"), "left").withColumn(out, F.coalesce("canonical", name)).drop("alias", "canonical")


def stable_id(number: Column, group: Column, offsets: dict[str, int], prefix: str = "COR-") -> Column:
    shift = F.coalesce(*[F.when(group == g, o) for g, o in offsets.items()], F.lit(0))
    return F.concat(F.lit(prefix), F.lpad((number + shift).cast("string"), 3, "0"))


def fingerprint(df: DataFrame, by: list[str], key: Column, out: str = "selection_hash") -> DataFrame:
    """SHA-256 of the sorted keys of each group."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256).alias(out))


@dataclass(frozen=True)
class Contract:
    """What clean_rows does with which columns. Names of output columns are those of the input but for code, day and street. ranges: (low, high) of a number, warned of outside; domains: allowed texts in upper case."""

    key: str = "record_id"
    severity: str = "injury"
    codes: tuple[tuple[str, str], ...] = tuple(SEVERITY.items())
    unknown: str = UNKNOWN
    code: str = "kabco"
    date: str = "event_date"
    day: str = "event_day"
    formats: tuple[str, ...] = DATE_FORMATS
    integers: tuple[str, ...] = ("lanes",)
    floats: tuple[str, ...] = ("speed",)
    texts: tuple[str, ...] = ()
    upper: tuple[str, ...] = ("flag",)
    latitude: str = "lat"
    longitude: str = "lon"
    bounds: tuple[float, float, float, float] = BOUNDS
    street: str | None = "street"
    ranges: tuple[tuple[str, float, float], ...] = (("speed", 1, 70),)
    domains: tuple[tuple[str, tuple[str, ...]], ...] = (("flag", ("Y", "N")),)
    order: tuple[str, ...] | None = None


def _parsed(raw: DataFrame, k: Contract) -> DataFrame:
    """Each text trimmed and each value parsed once, in projections of their own, under names that no input column has."""
    trim = dict.fromkeys((k.severity, k.date, *k.integers, *k.floats, *k.texts, *k.upper, k.latitude, k.longitude))
    street = [normalize_street(F.col(k.street)).alias("__street")] if k.street else []
    trimmed = raw.select(F.col(k.key).alias("__key"), *[normalize_string(F.col(c)).alias(f"__t_{c}") for c in trim], *street)
    numbers = dict.fromkeys((*k.integers, *k.floats, k.latitude, k.longitude))
    return trimmed.select("*", parse_date(F.col(f"__t_{k.date}"), k.formats).alias("__day"), *[F.col(f"__t_{c}").try_cast("double").alias(f"__v_{c}") for c in numbers])


def clean_rows(raw: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """One row out for each row in, with a fixed column order (that of contract.order, where given)."""
    k, t, v = contract, lambda c: F.col(f"__t_{c}"), lambda c: F.col(f"__v_{c}")
    status = _coordinate_status(t(k.latitude), t(k.longitude), v(k.latitude), v(k.longitude), k.bounds)
    out = _parsed(raw, k).withColumn("__status", status).select(
        F.col("__key").alias(k.key), t(k.severity).alias(f"{k.severity}_text"), map_severity(t(k.severity), dict(k.codes), k.unknown).alias(k.code), F.col("__day").alias(k.day), F.year("__day").alias("event_year"), F.trunc("__day", "month").alias("month_start"),
        *[F.when(v(c) % 1 == 0, v(c).cast("long")).alias(c) for c in k.integers], *[v(c).alias(c) for c in k.floats], *[t(c).alias(c) for c in k.texts], *[F.upper(t(c)).alias(c) for c in k.upper],
        F.col("__status").alias("coordinate_status"), (F.col("__status") == "valid").alias("has_valid_coordinates"), *([F.col("__street").alias(k.street)] if k.street else []),
    )
    return out.select(*k.order) if k.order else out


def invalid_counts(raw: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """(column_name, problem, n): how many values of the raw rows are invalid under the contract, and how many rows there are (column_name null): one pass."""
    k, t, v = contract, lambda c: F.col(f"__t_{c}"), lambda c: F.col(f"__v_{c}")
    status = _coordinate_status(t(k.latitude), t(k.longitude), v(k.latitude), v(k.longitude), k.bounds)
    checks = {(None, "rows"): F.lit(True), (k.severity, "unmapped"): t(k.severity).isNotNull() & ~F.coalesce(F.upper(t(k.severity)).isin(*dict(k.codes)), F.lit(False)), (k.date, "not_a_date"): F.col("__day").isNull()}
    checks |= {(c, "not_an_integer"): t(c).isNotNull() & F.coalesce(v(c) % 1 != 0, F.lit(True)) for c in k.integers} | {(c, "not_a_number"): t(c).isNotNull() & v(c).isNull() for c in k.floats}
    checks |= {(c, "outside_range"): F.coalesce(~v(c).between(low, high), F.lit(False)) for c, low, high in k.ranges} | {(c, "outside_domain"): F.coalesce(~F.upper(t(c)).isin(*allowed), F.lit(False)) for c, allowed in k.domains}
    checks |= {("coordinates", s): status == s for s in ("missing_pair", "incomplete_pair", "non_numeric", "out_of_range")}
    counts = _parsed(raw, k).agg(*[F.count_if(c).alias(f"c{n}") for n, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(c).cast("string").alias("column_name"), F.lit(p).alias("problem"), F.col(f"c{n}").alias("n")) for n, (c, p) in enumerate(checks)])
    return counts.select(F.inline(rows))
