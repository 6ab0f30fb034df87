"""Scalar helpers on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Characters that labels may not hold (fixed values).
SPECIAL = "[|@#!¡·$€%&()=?¿^*;:,¨`><+]"


def clean(text: Column) -> Column:
    """Every character that labels may not hold becomes an underscore."""
    return F.regexp_replace(text, SPECIAL, "_")


def threshold_of(path: Column) -> Column:
    """The number in ``confApB`` of a run's name; infinity without one."""
    a, b = (F.regexp_extract(path, r"conf(\d+)p(\d+)", k) for k in (1, 2))
    return F.when(a == "", float("inf")).otherwise(F.concat(a, F.lit("."), b).cast("double"))


def identifier(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")


def unique_identifier(name: Column, order: Column) -> Column:
    """Identifier made unique without regard to case by ``_n``."""
    n = F.row_number().over(Window.partitionBy(F.lower(identifier(name))).orderBy(order))
    return F.when(n == 1, identifier(name)).otherwise(F.concat(identifier(name), F.lit("_"), n))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def divisible(x: Column, d: int) -> Column:
    return (F.ceil(x / d) * d).cast("int")


def image_key(stem: Column) -> Column:
    """Whole-number stems without leading zeros, others as they are."""
    return F.coalesce(stem.try_cast("long").cast("string"), stem)


def label_path(image: Column) -> Column:
    """The label file of an image file: last /images/ to /labels/, suffix to .txt."""
    return F.regexp_replace(F.regexp_replace(image, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def numbers(values: list[Column], digits: int, significant: bool = False) -> Column:
    """The texts of numbers, blank between them, with ``digits`` decimals, or ``significant`` digits and no trailing zeros, as printf gives them.

    Zero has no sign; null, NaN and infinite numbers are null, NaN, Infinity and -Infinity. An Arrow function: the
    built-in formatter takes tens of microseconds a line.
    """
    form = f"%.{digits}{'g' if significant else 'f'}"
    whole, least = " ".join([form] * len(values)), 0.0 if significant else 10.0**-digits
    names = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}

    def one(v: float | None) -> str:
        text = "null" if v is None else form % v
        return names.get(text) or (text[1:] if v is not None and -least <= v <= 0 and not text.strip("-0.") and text[0] == "-" else text)

    def texts(*columns):
        import numpy as np
        import pyarrow as pa

        plain = all(not c.null_count and bool((np.isfinite(n) & ((n < -least) | (n > 0) | ((n == 0) & ~np.signbit(n)))).all()) for c in columns for n in [c.to_numpy(zero_copy_only=False)])
        rows = zip(*[c.to_pylist() for c in columns])
        return pa.array([whole % r for r in rows] if plain else [" ".join(map(one, r)) for r in rows], pa.string())

    return F.arrow_udf(texts, "string")(*[v.cast("double") for v in values])


def fixed(x: Column, digits: int) -> Column:
    """Decimal text, of the number's exact value; halves go to the even digit."""
    return numbers([x], digits)


def general(x: Column, digits: int = 6) -> Column:
    """Shortest text of ``digits`` significant digits: no trailing zeros, an exponent below -4 or from ``digits`` on."""
    return numbers([x], digits, significant=True)


def parsed_counts(items: Column) -> Column:
    """Map of NAME=COUNT items."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1).try_cast("int"))))


def nan_to_zero(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))
