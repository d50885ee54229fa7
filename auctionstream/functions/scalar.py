"""Column functions the queries share. All stay JVM-side."""

import re
from decimal import Decimal

from pyspark.sql import Column, functions as F

# Conversion rate, price bands and channel ids of the queries.
EURO_PER_DOLLAR = Decimal("0.908")
BAND_LIMITS = (10_000, 1_000_000)
CHANNEL_IDS = {"apple": "0", "google": "1", "facebook": "2", "baidu": "3"}


def to_euro(price: Column) -> Column:
    return (F.lit(EURO_PER_DOLLAR) * price).cast("decimal(23,3)")


def price_bands(price: Column) -> dict[str, Column]:
    """The three disjoint price bands, by name."""
    low, high = BAND_LIMITS
    return {
        "rank1": price < low,
        "rank2": (price >= low) & (price < high),
        "rank3": price >= high,
    }


def integer_avg(value: Column) -> Column:
    """Average of integers as an integer, cut towards zero."""
    return F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0)))


def count_char(text: Column, char: str) -> Column:
    """How often the one-byte character occurs; 0 for a null text."""
    if len(char.encode()) != 1:
        raise ValueError("count_char takes one ASCII character")
    hits = F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
    return F.coalesce(hits, F.lit(0)).cast("bigint")


def split_index(text: Column, separator: str, index: int) -> Column:
    """0-based part of the split text; null when there are not that many parts."""
    return F.get(F.split(text, re.escape(separator)), F.lit(index))


def regexp_group(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null, not '', when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def has_parameter(url: Column, name: str) -> Column:
    return F.instr(F.concat(F.lit("&"), url), f"&{name}=") > 0


def url_parameter(url: Column, name: str) -> Column:
    """Value of a url parameter up to the next '&'; null when the url lacks it.

    The same as group 2 of ``(&|^)name=([^&]*)``, without a regular expression per row.
    """
    marker = f"&{name}="
    padded = F.concat(F.lit("&"), url)
    behind = F.split_part(padded, F.lit(marker), F.lit(2))
    return F.when(has_parameter(url, name), F.substring_index(behind, "&", 1))


def day_of(ts: Column) -> Column:
    """yyyy-MM-dd; the cast of a date is cheaper than a formatter per row."""
    return F.to_date(ts).cast("string")


def minute_of(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def minute_number(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def minute_text(number: Column) -> Column:
    """Minute of the day as HH:mm."""
    hour, minute = F.floor(number / 60).cast("string"), (number % 60).cast("string")
    return F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"))


def bid_time_type(ts: Column) -> Column:
    """Day 8-18, night up to 6 and from 20; hours 7 and 19 belong to neither."""
    hour = F.hour(ts)
    return (
        F.when((hour >= 8) & (hour <= 18), "dayTime")
        .when((hour <= 6) | (hour >= 20), "nightTime")
        .otherwise("otherTime")
    )


def channel_id(channel: Column, url: Column) -> Column:
    case = F
    for name, number in CHANNEL_IDS.items():
        case = case.when(F.lower(channel) == name, number)
    return case.otherwise(url_parameter(url, "channel_id"))


def has_channel_id(channel: Column, url: Column) -> Column:
    """Whether ``channel_id`` is not null, without computing it."""
    return F.lower(channel).isin(*CHANNEL_IDS) | has_parameter(url, "channel_id")


def interval(duration: str) -> Column:
    """'10 seconds' as an interval column."""
    return F.expr(f"INTERVAL {duration}")
