"""Fields of text logs as column expressions, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constellation of a talker, labels of solution qualities and of road classes.
CONSTELLATIONS = {"GP": "G", "GL": "R", "GA": "E", "GB": "C", "GQ": "Q", "GN": "G"}
SOLUTION_LABELS = {1: "FIX", 2: "FLOAT", 3: "SBAS", 4: "DGPS", 5: "SINGLE", 6: "PPP"}
REPORT_LABELS = {1: "Fix", 2: "Float", 4: "DGPS", 5: "Single"}
CONDITION_LABELS = {0: "good", 1: "satisfactory", 2: "unsatisfactory", 3: "poor"}
SURFACE_CODES = {"tar": 0, "mudcon": 1, "mud": 2, "con": 3}


def label_of(code: Column, labels: dict, default) -> Column:
    """The label of a code, or the default [C10, C11, I33]."""
    out = None
    for key, value in labels.items():
        out = F.when(code == key, value) if out is None else out.when(code == key, value)
    return out.otherwise(default)


def nmea_degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm to degrees, negative in the south and west; null if it is no number [I3]."""
    x = value.try_cast("double")
    whole = F.floor(x / 100)
    degrees = whole + (x - 100 * whole) / 60
    return F.when(F.upper(hemisphere).isin("S", "W"), -degrees).otherwise(degrees)


def field(fields: Column, i: int) -> Column:
    """Field i, null if it is absent or empty."""
    return F.nullif(F.trim(F.get(fields, i)), F.lit(""))


def number(fields: Column, i: int, kind: str = "double") -> Column:
    return field(fields, i).try_cast(kind)


def is_digits(text: Column) -> Column:
    """[I24]"""
    return F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))


def without_checksum(sentence: Column) -> Column:
    """The sentence before its last ``*`` [I22]."""
    star = F.length(sentence) - F.length(F.substring_index(sentence, "*", -1)) - 1
    return F.when(sentence.contains("*"), F.substring(sentence, F.lit(1), star)).otherwise(sentence)


def constellation(talker: Column) -> Column:
    """Letter of a talker id; its second letter if it is unknown [I23]."""
    return F.coalesce(label_of(talker, CONSTELLATIONS, F.lit(None).cast("string")), F.substring(talker, 2, 1))


def groups_of(items: Column, size: int = 4) -> Column:
    """Whole groups of consecutive items [I25]."""
    n = F.floor(F.size(items) / size).cast("int")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def last_numbers(items: Column, n: int = 3) -> Column:
    """The last n items that are numbers, in order [I26]."""
    found = F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(found) >= n, F.slice(found, -n, n)).otherwise(found)


def is_number_input(text: Column) -> Column:
    """Digits and dots only, as settings accept [C29]."""
    return F.coalesce(text.rlike("^[0-9.]*$"), F.lit(False))


def rate_to_delay_ms(rate: Column) -> Column:
    return F.try_divide(F.lit(1000.0), rate)


def coordinate_json(lat: Column, lon: Column, decimals: int = 7) -> Column:
    return F.format_string(f"[%.{decimals}f,%.{decimals}f]", lat, lon)


def accuracy_colour(sdn: Column) -> Column:
    """[C12]"""
    return F.when(sdn < 1, "green").otherwise("orange")


def spike_colour(step: Column) -> Column:
    return F.when(step > 5, "red").when(step > 3, "black").otherwise("gray")
