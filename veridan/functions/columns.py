"""Column functions that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400


def seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(ts)


def smoothed_rate(events: Column, trials: Column) -> Column:
    """(events + 1) / (trials + 8)."""
    return (events + 1) / (trials + 8)


def safe_ratio(num: Column, den: Column, floor: float = 1.0) -> Column:
    """num over den, which counts as ``floor`` at least."""
    return num / F.greatest(den, F.lit(floor))


def split_unit(ring: str = "ring_id", household: str = "household_id", customer: str = "customer_id") -> Column:
    """The unit that must not be split between folds: ring, else household, else customer."""
    return (
        F.when(F.col(ring) >= 0, F.concat(F.lit("ring_"), F.col(ring)))
        .when(F.col(household) >= 0, F.concat(F.lit("hh_"), F.col(household)))
        .otherwise(F.concat(F.lit("cust_"), F.col(customer)))
    )


def band(p: str | Column, lo: float, hi: float) -> Column:
    """auto_action from hi, review from lo, else pass."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= hi, "auto_action").when(p >= lo, "review").otherwise("pass")


def intrinsic(category_values: list[str]) -> dict[str, Column]:
    """What an order says by itself: value, size, time of day and week (Sunday is 0), category flags."""
    t = seconds("order_ts")
    hour = F.floor(F.pmod(t, F.lit(DAY)) / 3600).cast("int")
    out = {
        "log_value": F.log1p("value_inr"),
        "hour_of_day": hour,
        "day_of_week": (F.pmod(F.floor(t / DAY) + 4, F.lit(7))).cast("int"),
        "is_night": (hour < 6).cast("int"),
    }
    return out | {f"cat_{c.lower().replace(' ', '_')}": (F.col("category") == c).cast("int") for c in category_values}


# Words of address lines and what they stand for, and words that say nothing.
SYNONYMS = {
    "apts": "apartments", "apt": "apartments", "aprtmnt": "apartments", "apartment": "apartments", "appartments": "apartments",
    "res": "residency", "resi": "residency", "residancy": "residency", "twr": "towers", "tower": "towers", "twrs": "towers",
    "bldg": "building", "bld": "building", "blg": "building", "hts": "heights", "ht": "heights", "encl": "enclave",
    "cmplx": "complex", "cmpx": "complex", "chmbrs": "chambers", "chmbr": "chambers", "rd": "road", "marg": "road",
    "st": "street", "ln": "lane", "sec": "sector", "nr": "near", "opp": "opposite", "gr": "ground", "flr": "floor", "fl": "floor",
}
FILLER = ["flat", "flt", "apt", "no", "number", "num", "house", "h", "the", "wing", "block", "blk", "door", "d"]


def address_words(raw: str) -> Column:
    """Words of an address line without filler, synonyms replaced. Filler goes first, so a leading ``Apt`` is filler and ``Apts`` a word."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(raw), F.lit(""))), "[^a-z0-9]+", " "))
    words = F.split(F.regexp_replace(clean, r"\b(\d+) ([a-z])\b", "$1$2"), " ")
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.filter(words, lambda w: (w != "") & ~w.isin(FILLER))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(synonyms, w), w))


def with_address_parts(addresses: DataFrame, raw: str, flat: str, words: str) -> DataFrame:
    """``addresses`` with the flat ('?' without one) and the sorted distinct other words of an address line.

    The first word like ``12b`` is the flat; later ones are words. The steps are columns of their own, so that each is
    computed once a row.
    """
    out = addresses.withColumn("_words", address_words(raw))
    out = out.withColumn("_flat", F.array_position(F.transform("_words", lambda w: w.rlike(r"^\d{1,4}[a-h]?$")), True).cast("int"))
    rest = F.when(F.col("_flat") > 0, F.concat(F.slice("_words", 1, F.col("_flat") - 1), F.expr("slice(_words, _flat + 1, size(_words))"))).otherwise(F.col("_words"))
    out = out.withColumns({flat: F.when(F.col("_flat") > 0, F.get("_words", F.col("_flat") - 1)).otherwise("?"), words: F.sort_array(F.array_distinct(rest))})
    return out.drop("_words", "_flat")


def with_address_cluster(addresses: DataFrame, name: str = "cluster", pincode: str = "pincode", raw: str = "raw_line") -> DataFrame:
    """``addresses`` with one key for all spellings of a door: a function of the row alone."""
    out = with_address_parts(addresses, raw, "_door", "_rest")
    return out.withColumn(name, F.concat_ws("|", F.col(pincode), "_door", F.array_join("_rest", " "))).drop("_door", "_rest")
