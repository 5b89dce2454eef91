"""Cleaning: guards on dimensions and dates, symbol and name normalisation, disclosure rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fundamental dimensions as first reported; restated ones would leak the future.
AS_REPORTED = ("ARQ", "ART", "ARY")
#: Spellings of no symbol.
NO_SYMBOL = ("", "--", "N/A", "NONE")


def unpivot_facts(wide: DataFrame, dimension: str, measures: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """ids, tag, value of the non-null measures of one as-reported dimension."""
    if dimension not in AS_REPORTED:
        raise ValueError(f"dimension {dimension} is restated; use one of {', '.join(AS_REPORTED)}")
    return wide.where(F.col("dimension") == dimension).unpivot([F.col(i) for i in ids], [F.col(m).cast("double").alias(m) for m in measures], "tag", "value").where("value IS NOT NULL")


def available(facts: DataFrame, tags: Sequence[str], start, end) -> DataFrame:
    """Facts of some tags by the window of their filing date."""
    return facts.where(F.col("tag").isin(*tags) & F.col("filed").between(start, end))


def symbol(x: Column) -> Column:
    """Upper case, trimmed, dots as hyphens."""
    return F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-"))


def person_name(x: Column) -> Column:
    """Without a leading title, underscores as spaces, title case."""
    return F.initcap(F.replace(F.regexp_replace(x, r"^(?i)(hon|mr|mrs|ms|dr)[._ ]+", ""), F.lit("_"), F.lit(" ")))


def trade_side(x: Column) -> Column:
    return F.when(x == "Purchase", "buy").when(x.startswith("Sale"), "sell").otherwise("other")


def owner_class(x: Column) -> Column:
    own = F.upper(F.trim(x))
    return (
        F.when(own.isNull() | own.isin("", "SELF", "--"), "self").when(own.contains("SPOUSE") | (own == "SP"), "spouse")
        .when(own.contains("DEPEND") | own.contains("CHILD") | (own == "DC"), "dependent").when(own.contains("JOINT") | (own == "JT"), "joint").otherwise("self")
    )


def has_code(codes: Column, code: str) -> Column:
    """Whether a pipe-separated list holds a code."""
    return F.array_contains(F.split(codes, r"\|"), code)


def lag_days(later: str, earlier: str) -> Column:
    return F.datediff(F.col(later), F.col(earlier))


def clean_disclosures(rows: DataFrame, common: DataFrame, most_days: int = 730) -> tuple[DataFrame, DataFrame]:
    """Rows with both dates, a symbol among the ``ticker`` of ``common`` equities and a lag of 0..``most_days``,
    and one row of the counts of each reason to drop.

    Each of no_date, no_symbol and not_common (a symbol that is none of a common equity) counts on its
    own, so a row may count several times; bad_lag counts rows that nothing else drops.
    """
    own = rows.withColumns({"ticker": symbol(F.col("ticker")), "transaction_date": F.try_to_date(F.col("transaction_date").cast("string")), "filing_date": F.try_to_date(F.col("filing_date").cast("string"))})
    known = common.select(symbol(F.col("ticker")).alias("ticker")).distinct().withColumn("__common", F.lit(True))
    own = own.join(known, "ticker", "left").select(*rows.columns, "__common")
    blank = F.col("ticker").isNull() | F.col("ticker").isin(*NO_SYMBOL)
    undated = F.col("transaction_date").isNull() | F.col("filing_date").isNull()
    other = ~blank & F.col("__common").isNull()
    late = ~(blank | undated | other) & ~lag_days("filing_date", "transaction_date").between(0, most_days)
    reasons = {"no_date": undated, "no_symbol": blank, "not_common": other, "bad_lag": late}
    flagged = own.withColumns({f"__{name}": F.coalesce(cond, F.lit(False)) for name, cond in reasons.items()})
    kept = ~reduce(lambda a, b: a | b, (F.col(f"__{name}") for name in reasons))
    counts = flagged.agg(F.count(F.lit(1)).alias("n_in"), *(F.count_if(F.col(f"__{name}")).alias(name) for name in reasons), F.count_if(kept).alias("n_out"))
    return flagged.where(kept).select(*rows.columns), counts


def period(year: Column, ranges: Sequence[tuple[str, int, int]]) -> Column:
    """The name of the first range that holds the year, else ``other``."""
    out = F.lit("other")
    for name, low, high in reversed(ranges):
        out = F.when(year.between(low, high), name).otherwise(out)
    return out


def open_market_purchases(rows: DataFrame) -> DataFrame:
    """Purchases (code P) with all required fields; ``value`` is the absolute transaction value."""
    return rows.where(F.col("transactioncode") == "P").withColumn("value", F.abs(F.col("transactionvalue"))).dropna(subset=["ticker", "filingdate", "ownername", "value"])


def latest_reference(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The latest row of each key."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
