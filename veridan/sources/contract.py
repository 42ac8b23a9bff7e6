"""What each input must look like: types, nulls, ranges and values, checked row by row in one pass.

Every rule that a row breaks is a reason; rows with reasons are kept aside with them, the others go on with the declared types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType


@dataclass(frozen=True)
class Rule:
    """A column's type; whether it may be null; its least and greatest value; the values it may have."""

    kind: DataType
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] | None = None


_ID = Rule(LongType(), low=0)
CONTRACT: dict[str, dict[str, Rule]] = {
    "orders": {
        "order_id": _ID, "customer_id": _ID, "device_id": _ID, "address_id": _ID, "phone_id": _ID, "order_ts": Rule(TimestampType()), "payment_mode": Rule(StringType(), values=("COD", "prepaid")),
        "category": Rule(StringType()), "value_inr": Rule(DoubleType(), low=0), "item_count": Rule(ShortType(), low=1), "promo_used": Rule(ByteType(), low=0, high=1),
    },
    "returns": {"order_id": _ID, "return_ts": Rule(TimestampType())},
    "customers": {"customer_id": _ID, "signup_ts": Rule(TimestampType())},
    "addresses": {"address_id": _ID, "raw_line": Rule(StringType(), nullable=True), "pincode": Rule(IntegerType(), low=100_000, high=999_999)},
    "phones": {"phone_id": _ID, "msisdn": Rule(StringType(), nullable=True)},
}


def schema(name: str, contract: dict[str, dict[str, Rule]] = CONTRACT) -> StructType:
    """The declared schema of an input: what a typed reader takes."""
    return StructType([StructField(c, r.kind, r.nullable) for c, r in contract[name].items()])


def _broken(column: str, r: Rule) -> list[Column]:
    """The reasons of one column: null, type, low, high, value."""
    c, typed = F.col(column), F.col(column).try_cast(r.kind)
    out = [] if r.nullable else [F.when(c.isNull(), f"{column}: null")]
    out.append(F.when(c.isNotNull() & typed.isNull(), f"{column}: type"))
    if r.low is not None:
        out.append(F.when(typed < r.low, f"{column}: below {r.low}"))
    if r.high is not None:
        out.append(F.when(typed > r.high, f"{column}: above {r.high}"))
    if r.values is not None:
        out.append(F.when(c.isNotNull() & ~typed.isin(*r.values), f"{column}: value"))
    if isinstance(r.kind, DoubleType):
        out.append(F.when(F.isnan(typed), f"{column}: not a number"))
    return out


def reasons(name: str, df: DataFrame, contract: dict[str, dict[str, Rule]] = CONTRACT) -> DataFrame:
    """``df`` with ``reasons``, the rules that each row breaks. ValueError if a column is absent; further columns are ignored."""
    rules = contract[name]
    if missing := sorted(set(rules) - set(df.columns)):
        raise ValueError(f"{name} lacks {missing}")
    df = df.select(*rules)
    return df.withColumn("reasons", F.array_compact(F.array(*[b for c, r in rules.items() for b in _broken(c, r)])))


def accepted(name: str, checked: DataFrame, contract: dict[str, dict[str, Rule]] = CONTRACT) -> DataFrame:
    """Rows that break no rule, in the declared types."""
    good = checked.where(F.size("reasons") == 0)
    return good.select(*[F.col(c).try_cast(r.kind).alias(c) for c, r in contract[name].items()])


def rejected(name: str, checked: DataFrame) -> DataFrame:
    """(input, reasons, row): the rows that break a rule, as JSON."""
    return checked.where(F.size("reasons") > 0).select(F.lit(name).alias("input"), "reasons", F.to_json(F.struct(*[c for c in checked.columns if c != "reasons"])).alias("row"))


def report(checked: dict[str, DataFrame]) -> DataFrame:
    """(input, reason, n): how many rows of each input break each rule; reason ``rows`` counts all, ``rejected`` those with any reason."""
    out = None
    for name, df in checked.items():
        marks = F.concat(F.array(F.lit("rows")), F.when(F.size("reasons") > 0, F.array(F.lit("rejected"))).otherwise(F.array().cast("array<string>")), "reasons")
        one = df.select(F.lit(name).alias("input"), F.explode(marks).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("input", "reason").agg(F.count("*").alias("n"))
