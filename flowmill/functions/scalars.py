"""Scalar functions of flow records as column expressions. Division by data never raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_IPV4, NO_IPV6 = "0.0.0.0", "::"
# Header sizes in bytes for the header-to-payload estimate.
IPV4_HEADER, IPV6_HEADER, DEFAULT_L4_HEADER = 20, 40, 20
L4_HEADERS = {6: 20, 17: 8, 1: 8}
SCTP, SCTP_HEADER = 132, 12
# What attack labels carry besides the attack's name.
LABEL_NOISE = (
    "Friday", "Saturday", "Tuesday", "Wednesday", "Thursday", " morning ", " afternoon ", " night ", "advanced ", " - minimal aggresivity",
    " - low aggresivity", " - medium aggresivity", " - high aggresivity",
)


def unify_ip(v4: Column, v6: Column) -> Column:
    """The IPv4 address where the IPv6 one is unset, else the IPv6 address."""
    return F.when(v6 == NO_IPV6, v4).otherwise(v6)


def window_duration(start_ms: Column, end_ms: Column) -> Column:
    """Seconds; a zero-length flow counts as 10 ms."""
    return F.when(end_ms == start_ms, F.lit(0.01)).otherwise((end_ms - start_ms) / F.lit(1000.0))


def rounded(value: Column | str, digits: int = 0) -> Column:
    """Rounded as DuckDB does: times 10^digits, to the nearest whole number, halves away from zero; what isn't finite stays.

    Spark's round goes by the decimal digits instead: 3.5e-05 at 5 digits is 4e-05 there and 3e-05 here, as 3.5e-05 * 1e5 is below 3.5.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    tens = F.lit(10.0 ** abs(digits))
    out = F.round(v * tens) / tens if digits >= 0 else F.round(v / tens) * tens
    return F.when(F.abs(out) < float("inf"), out).when(out.isNotNull(), v)


def side_duration(ms: Column) -> Column:
    """Seconds of one direction; nothing sent counts as 1 ms."""
    return F.when(ms > 0, ms / F.lit(1000.0)).otherwise(F.lit(0.001))


def per(amount: Column, unit: Column) -> Column:
    """amount / unit; 0/0 is 0 and x/0 infinite, as floating-point arithmetic with NaN replaced has it."""
    unit, amount = unit.cast("double"), amount.cast("double")
    return F.when(unit != 0, F.try_divide(amount, unit)).when(amount == 0, F.lit(0.0)).otherwise(F.lit(float("inf")) * F.signum(amount))


def rates(side: str) -> list[Column]:
    """Bytes and packets per second and bytes per packet of direction IN or OUT."""
    seconds, size, packets = side_duration(F.col(f"DURATION_{side}")), F.col(f"{side}_BYTES"), F.col(f"{side}_PKTS")
    return [per(size, seconds).alias(f"{side}_BPS"), per(size, packets).alias(f"{side}_BPP"), per(packets, seconds).alias(f"{side}_PPS")]


def header_ratio(ip: Column, protocol: Column, packets: Column, size: Column, strict_compat: bool = True) -> Column:
    """Estimated header bytes over all bytes."""
    ip_header = F.when(ip.contains("."), IPV4_HEADER).otherwise(IPV6_HEADER)
    l4 = F.when(F.lit(not strict_compat) & (protocol == SCTP), SCTP_HEADER)
    for number, header in L4_HEADERS.items():
        l4 = l4.when(protocol == number, header)
    return per((ip_header + l4.otherwise(DEFAULT_L4_HEADER)) * packets, size)


def time_bucket(epoch_s: Column, seconds: int) -> Column:
    """Start of the left-closed bucket as text, in the session's time zone."""
    return F.from_unixtime(epoch_s - epoch_s % seconds)


def rescale(value: Column, low: float, high: float) -> Column:
    """(value - low) / (high - low), clamped to [0, 1]."""
    return clip01((value - F.lit(low)) / F.lit(high - low))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def safe_rate(amount: Column, seconds: Column) -> Column:
    """amount / seconds; null for zero seconds."""
    return F.try_divide(amount.cast("double"), seconds.cast("double"))


# Column-name parts that trade places, and whether they stand at the name's start.
SIDES = (("IN_", "OUT_", True), ("CLIENT_", "SERVER_", True), ("SRC_TO_DST", "DST_TO_SRC", True), ("_SRC_", "_DST_", False))


def swapped_name(name: str) -> str:
    """The column that takes this one's place when source and destination are swapped: the first pair that applies."""
    for pair in SIDES:
        for old, new in (pair[:2], pair[1::-1]):
            if name.startswith(old) if pair[2] else old in name:
                return name.replace(old, new) if not pair[2] else new + name.removeprefix(old)
    return name


def swap_sides(df: DataFrame) -> DataFrame:
    """Rename columns so that source and destination trade places; the column order stays."""
    have = set(df.columns)
    return df.select(*(F.col(s if (s := swapped_name(c)) in have else c).alias(c) for c in df.columns))


def clean_label(label: Column) -> Column:
    """Drop weekday, time-of-day and intensity words, trim, and number the variant."""
    return F.concat(F.trim(F.regexp_replace(label, "|".join(LABEL_NOISE), "")), F.lit("_1"))


def day_of_month(ms: Column) -> Column:
    """In the session's time zone."""
    return F.dayofmonth(F.timestamp_millis(ms))


def day_type(date: Column) -> Column:
    return F.when(F.dayofweek(date).isin(1, 7), F.lit("weekend")).otherwise(F.lit("workday"))


def seconds_to_millis(x: Column) -> Column:
    return (x * 1000).cast("long")


def millis_to_seconds(x: Column) -> Column:
    return x / F.lit(1000.0)


def micros_to_millis(x: Column) -> Column:
    return F.floor(x / 1000)


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds of a time's text, with its fraction; null if it isn't one."""
    return F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)


def floor_millis(seconds: Column) -> Column:
    """Epoch seconds rounded down to 1 ms."""
    return F.floor(seconds * 1000) / F.lit(1000.0)


def ceil_millis(seconds: Column) -> Column:
    return F.ceil(seconds * 1000) / F.lit(1000.0)


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; null if it isn't one."""
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * F.lit(1 << (8 * (3 - i))) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).try_cast("long") * F.lit(1 << 24))
    return F.when(F.size(parts) == 4, number)


def ipv4_text(number: Column) -> Column:
    """The dotted address of a number."""
    return F.concat_ws(".", *[(F.shiftright(number, 8 * i).bitwiseAND(F.lit(255))).cast("string") for i in (3, 2, 1, 0)])
