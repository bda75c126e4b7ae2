"""NMEA logs: ``NMEA,<sentence>,<unix ms>`` lines, or bare sentences [A1-A5].

Malformed lines and fields become nulls and go. One ``sentences`` frame is parsed once; each kind is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.functions.timeconv import floor_second, nmea_time

KEYS = ["file", "line_no", "ts_ms", "sec"]
# Fixed value: position, dop and count limits are in operators.quality; a timestamp has ten digits or more.
LEAST_DIGITS = 10


def sentences(lines: DataFrame, *, bare: bool = True) -> DataFrame:
    """(file, line_no, ts_ms, sec, talker, type, f). The time may be followed by ``*`` and a checksum."""
    wrapped = F.col("line").startswith("NMEA,")
    stamp = F.substring_index(F.substring_index("line", ",", -1), "*", 1)
    body = F.when(wrapped, F.regexp_extract("line", r"^NMEA,(.*),[^,]*$", 1)).otherwise(F.col("line"))
    kept = lines.filter(wrapped | (F.lit(bare) & F.col("line").startswith("$")))
    ms = F.when(wrapped & (F.length(F.trim(stamp)) >= LEAST_DIGITS), F.trim(stamp).try_cast("long"))
    parts = F.struct(ms.alias("ts_ms"), wrapped.alias("wrapped"), F.split(T.without_checksum(body), ",").alias("f"))
    # one generated row for each line: the split is done once, not again in every column that reads a field
    parsed = kept.select("file", "line_no", F.explode(F.array(parts)).alias("p")).filter(~F.col("p.wrapped") | F.col("p.ts_ms").isNotNull())
    head = F.get("p.f", 0)
    return parsed.select(
        "file", "line_no", F.col("p.ts_ms").alias("ts_ms"), floor_second(F.col("p.ts_ms")).alias("sec"),
        F.substring(head, 2, 2).alias("talker"), F.substring(head, 4, 3).alias("type"), F.col("p.f").alias("f"),
    )


def gga(found: DataFrame) -> DataFrame:
    """Fixes: lat, lon, q, nsat, hdop, alt, and the UTC time of day."""
    f = F.col("f")
    fixes = found.filter(F.col("type") == "GGA").select(
        *KEYS,
        T.field(f, 1).alias("hhmmss"),
        T.nmea_degrees(T.field(f, 2), T.field(f, 3)).alias("lat"),
        T.nmea_degrees(T.field(f, 4), T.field(f, 5)).alias("lon"),
        T.number(f, 6, "int").alias("q"),
        T.number(f, 7, "int").alias("nsat"),
        T.number(f, 8).alias("hdop"),
        T.number(f, 9).alias("alt"),
    )
    return fixes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("q").isNotNull())


def gsv(found: DataFrame) -> DataFrame:
    """A row for each satellite in view: svid, prn, elev, az, snr; groups of four fields, a trailing signal id is none."""
    groups = T.groups_of(F.slice("f", F.lit(5), F.greatest(F.lit(0), F.size("f") - 4)))
    rows = found.filter(F.col("type") == "GSV").select(*KEYS, "talker", F.posexplode(groups).alias("slot", "g"))
    prn = T.field(F.col("g"), 0)
    return rows.select(
        *KEYS, "slot", prn.alias("prn"),
        F.concat(T.constellation(F.col("talker")), prn).alias("svid"),
        T.number(F.col("g"), 1).alias("elev"), T.number(F.col("g"), 2).alias("az"), T.number(F.col("g"), 3).alias("snr"),
    ).filter(T.is_digits(F.col("prn")))


def gsa(found: DataFrame) -> DataFrame:
    """Used satellites and dilutions of precision, by their places: 3-14 and 15, 16, 17."""
    f = F.col("f")
    used = F.filter(F.transform(F.slice(f, 4, 12), lambda x: F.trim(x)), lambda x: x != "")
    return found.filter((F.col("type") == "GSA") & (F.size(f) >= 18)).select(
        *KEYS, used.alias("used"), T.number(f, 15).alias("pdop"), T.number(f, 16).alias("hdop"), T.number(f, 17).alias("vdop")
    )


def rmc(found: DataFrame) -> DataFrame:
    """Date and time; bare logs take their epoch from it."""
    f = F.col("f")
    return found.filter(F.col("type") == "RMC").select(*KEYS, nmea_time(T.field(f, 1), T.field(f, 9)).alias("utc"), T.field(f, 2).alias("status"))
