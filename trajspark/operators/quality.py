"""Per-second quality of GNSS epochs [C4-C9, D1-D4, D6, D7, E1-E5]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Limits of a gate. lenient: epochs without data pass, and so do missing dilutions."""

    min_snr: float
    min_elevation: float | None
    min_sats: int
    max_hdop: float
    max_pdop: float | None = None
    null_tolerant: bool = False
    used_only: bool = False


# The four gates.
SIMPLE = Gate(25, None, 4, 2.0)
SIMPLE_TIGHT = Gate(25, None, 6, 1.5)
STRICT = Gate(30, 15, 5, 2.0, 4.0, null_tolerant=True)
LENIENT = Gate(28, 10, 6, 5.0, 10.0, null_tolerant=True, used_only=True)


def best_fix(fixes: DataFrame, keys: list[str], order: list[str], quality: str = "q") -> DataFrame:
    """Of each second the row of the highest quality, the earliest of equal ones [E1]."""
    w = Window.partitionBy(*keys).orderBy(F.desc(quality), *order)
    return fixes.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def last_and_first(rows: DataFrame, keys: list[str], order: str, last: list[str], first: list[str]) -> DataFrame:
    """Last value that is not null of some columns, first of others [E2]."""
    pick = lambda f, c: f(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*[pick(F.max_by, c) for c in last], *[pick(F.min_by, c) for c in first])


def snr_lists(sats: DataFrame, keys: list[str]) -> DataFrame:
    """Signal strengths over 0 of each second, in order [E3]."""
    own = sats.filter("snr > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "slot", "snr"))).alias("x"))
    return own.select(*keys, F.transform("x", lambda s: s["snr"]).alias("snrs"))


def good_satellite(gate: Gate, snr: Column, elevation: Column | None = None, used: Column | None = None) -> Column:
    good = snr >= gate.min_snr
    if gate.min_elevation is not None and elevation is not None:
        good = good & (elevation >= gate.min_elevation)
    if gate.used_only and used is not None:
        good = good & ~used.eqNullSafe(F.lit(False))
    return F.coalesce(good, F.lit(False))


def good_counts(sats: DataFrame, keys: list[str], gate: Gate) -> DataFrame:
    """[E4]"""
    column = lambda c: F.col(c) if c in sats.columns else None
    return sats.groupBy(*keys).agg(F.count_if(good_satellite(gate, F.col("snr"), column("elev"), column("used"))).cast("long").alias("good_sats"))


def used_sets(dops: DataFrame, keys: list[str]) -> DataFrame:
    """[E5]"""
    return dops.select(*keys, F.explode("used").alias("prn")).groupBy(*keys).agg(F.collect_set("prn").alias("used_prns"))


def mark_used(sats: DataFrame, used: DataFrame, keys: list[str], prn: str = "prn") -> DataFrame:
    """Whether a satellite is in the used set of its second; null if the second has none [D7]."""
    return sats.join(used, keys, "left").withColumn("used", F.array_contains("used_prns", F.col(prn))).drop("used_prns")


def passes(gate: Gate, good_sats: Column, hdop: Column, pdop: Column | None = None, has_data: Column | None = None) -> Column:
    """[C6-C8]"""
    within = lambda x, most: (x.isNull() | (x <= most)) if gate.null_tolerant else F.coalesce(x <= most, F.lit(False))
    ok = (F.coalesce(good_sats, F.lit(0)) >= gate.min_sats) & within(hdop, gate.max_hdop)
    if gate.max_pdop is not None and pdop is not None:
        ok = ok & within(pdop, gate.max_pdop)
    return ok if has_data is None else (~has_data | ok)


def merge_epochs(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of one-row-a-second frames by one union and one aggregation [D2, H1]; flags tell who has a row."""
    tagged = None
    names = [c for df in frames.values() for c in df.columns if c not in keys]
    for tag, df in frames.items():
        own = df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast(_kind(frames, c)).alias(c) for c in names], F.lit(tag).alias("__tag"))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names], *[(F.count_if(F.col("__tag") == tag) > 0).alias(f"has_{tag}") for tag in frames])


def _kind(frames: dict[str, DataFrame], column: str):
    return next(df.schema[column].dataType for df in frames.values() if column in df.columns)


def fallback_join(left: DataFrame, right: DataFrame, keys: list[str], second: str, value: str, offsets: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """The value of the same second, else of the first offset that has one [D3]: one shuffle of right, copied per offset."""
    copies = right.select(*keys, value, F.col(second), F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("by")) for i, o in enumerate(offsets)])).alias("o"))
    moved = copies.filter(F.col(value).isNotNull()).select(*keys, (F.col(second) - F.col("o.by")).alias(second), F.col("o.rank").alias("rank"), value)
    best = moved.groupBy(*keys, second).agg(F.min_by(value, "rank").alias(value))
    return left.join(best, [*keys, second], "left")


def prefer(primary: Column, secondary: Column) -> Column:
    """First source if it has a value [D4]; an empty list is none."""
    return F.coalesce(F.when(F.size(primary) > 0, primary), secondary)


def lookup_keep(fixes: DataFrame, quality: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Fixes whose second passes or has no quality row [D1]."""
    return fixes.join(quality.select(*keys, ok), keys, "left").filter(F.coalesce(ok, F.lit(True))).drop(ok)


def without_seconds(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """[D6]"""
    return rows.join(dropped.select(*keys).distinct(), keys, "left_anti")


def reject_reason(q: Column, ns: Column, sdn: Column, sde: Column, *, max_q: int = 5, min_ns: int = 4, max_deviation: float = 5.0, inside: Column | None = None) -> Column:
    """Name of the first gate that a row fails, null if it passes [C9]."""
    first = F.when(~inside, "box") if inside is not None else F.when(F.lit(False), "box")
    return first.when(q > max_q, "q").when(ns < min_ns, "ns").when((sdn > max_deviation) | (sde > max_deviation), "sd")


def pass_ratio(ok: Column) -> Column:
    """Share in percent [E18]."""
    return 100.0 * F.count_if(ok) / F.greatest(F.lit(1), F.count(F.lit(1)))


def classify_now(rows: DataFrame, by: list[str], order: list[str], flag: Column, *, least_speed: float = 5.0) -> DataFrame:
    """Rows at which a road is classified: the flag is set, the speed is over ``least_speed`` and the position is new [C16]."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lag("lat").over(w).eqNullSafe(F.col("lat")) & F.lag("lon").over(w).eqNullSafe(F.col("lon"))
    return rows.withColumn("__new", ~same).filter(F.col("__new") & flag & (F.col("speed") > least_speed)).drop("__new")
