"""Field mapping and the sync of a source: rename, default, transform, validate, quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date formats that sources use, in the order in which they are tried.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM"]

#: Named transforms that mappings may use; add to it to plug in another.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "strip": F.trim,
    "int": lambda c: c.cast("string").try_cast("long"),
    "float": lambda c: c.cast("string").try_cast("double"),
    "iso_time": lambda c: iso_time(c),
    "split_comma": lambda c: F.split(c, r"\s*,\s*"),
}


def iso_time(value: Column) -> Column:
    """UTC time in ISO form from epoch seconds or one of DATE_FORMATS; offsets are converted, other strings stay.

    Times without an offset are UTC. The session's time zone plays no part: text is parsed with an offset, and written
    from seconds since the epoch.
    """
    text = value.cast("string")
    epoch = F.timestamp_seconds(text.try_cast("double"))
    parsed = [F.try_to_timestamp(text, F.lit(DATE_FORMATS[0].replace("[XXX]", "XXX")))]
    parsed += [F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(f.replace("[XXX]", "") + "XXX")) for f in DATE_FORMATS]
    seconds = F.floor(F.unix_micros(F.coalesce(epoch, *parsed)) / 1_000_000)
    day, second = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    iso = F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.coalesce(F.when(seconds.isNotNull(), iso), text)


def map_fields(df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """fields: {target: {"source", "default", "required", "transform"}}; unmapped columns are kept as _raw_<name>.

    A required field that is null without a default makes the row raise when it is read.
    """
    out, used = [], set()
    for target, f in fields.items():
        source = f.get("source", target)
        used.add(source)
        c = F.col(source) if source in df.columns else F.lit(None).cast("string")
        if "transform" in f:
            c = TRANSFORMS[f["transform"]](c)
        if "default" in f:
            c = F.coalesce(c, F.lit(f["default"]))
        if f.get("required"):
            c = F.coalesce(c, F.raise_error(F.lit(f"field {target} is missing")).cast(df.select(c.alias("x")).schema["x"].dataType))
        out.append(c.alias(target))
    return df.select(*out, *(F.col(c).alias(f"_raw_{c}") for c in df.columns if c not in used))


def sync(df: DataFrame, fields: dict[str, dict], valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of the mapped source; a null verdict is not valid."""
    mapped = map_fields(df, fields)
    ok = F.coalesce(valid, F.lit(False))
    return mapped.where(ok), mapped.where(~ok)


def latest_changes(log: DataFrame, key: str, order: list[str], operation: str = "op") -> DataFrame:
    """The state after a change log of I, U and D rows: the last change of each key unless it deletes."""
    place = F.struct(*order)
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), place).alias("r"))
    return last.where(F.col(f"r.{operation}") != "D").select(key, *(F.col("r")[c].alias(c) for c in log.columns if c not in (key, operation)))
