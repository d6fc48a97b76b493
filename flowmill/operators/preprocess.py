"""Raw flow records to the 110 model features: one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import ports, scalars

# Numeric fields that are features as they are.
NUMERIC = (
    "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "MIN_TTL", "MAX_TTL", "SRC_FRAGMENTS", "DST_FRAGMENTS",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES",
    "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES", "NUM_PKTS_OVER_1514_BYTES", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT",
    "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_PKTS", "OOORDER_IN_PKTS", "OOORDER_OUT_PKTS", "DURATION_IN", "DURATION_OUT", "TCP_WIN_MIN_IN",
    "TCP_WIN_MAX_IN", "TCP_WIN_MSS_IN", "TCP_WIN_SCALE_IN", "TCP_WIN_MIN_OUT", "TCP_WIN_MAX_OUT", "TCP_WIN_MSS_OUT", "TCP_WIN_SCALE_OUT",
    "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX",
    "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
)
ADDRESS = ("IPV4_SRC_ADDR", "IPV6_SRC_ADDR", "IPV4_DST_ADDR", "IPV6_DST_ADDR")
DECODED = ("PROTOCOL", "L4_SRC_PORT", "L4_DST_PORT", "ICMP_TYPE", "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS")
#: Fields that are no features and are dropped: addresses after unifying, times, verdicts.
DROPPED = (*ADDRESS, "DIRECTION", "FLOW_VERDICT", "APPLICATION_ID", "FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS", "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS")
EXTRA = ("Label", "SRC_DENY", "DST_DENY")


def features(flows: DataFrame, keep: tuple[str, ...] = EXTRA) -> DataFrame:
    """IP_SRC, IP_DST, the 110 features, and those columns of `keep` that are there.

    Numeric fields that the input lacks are 0, the value of an unset field. An empty input has the same columns.
    """
    have = set(flows.columns)
    missing = [n for n in (*NUMERIC, *DECODED) if n not in have]
    flows = flows.withColumns({n: F.lit(0) for n in missing}) if missing else flows
    icmp = ports.icmp_type_name(F.col("ICMP_TYPE"))
    protocol = ports.protocol_name(F.col("PROTOCOL"))
    hot: list[Column] = ports.one_hot(protocol, "PROTOCOL", ports.PROTOCOL_VALUES)
    for side in ("SRC", "DST"):
        hot += ports.one_hot(ports.port_category(F.col(f"L4_{side}_PORT")), f"L4_{side}_PORT", ports.PORT_VALUES)
    for value in ports.ICMP_VALUES:
        # Type 0 is also the field's unset value: an echo reply counts only for ICMP.
        hit = (icmp == value) & (protocol == "ICMP") if value == "ECHO_REPLY" else icmp == value
        hot.append(hit.cast("byte").alias(f"ICMP_TYPE_{value}"))
    flags = [x for prefix in ("", "CLIENT", "SERVER") for x in ports.flag_bits(F.col(f"{prefix}_TCP_FLAGS" if prefix else "TCP_FLAGS"), prefix)]
    return flows.select(
        scalars.unify_ip(F.col("IPV4_SRC_ADDR"), F.col("IPV6_SRC_ADDR")).alias("IP_SRC"), scalars.unify_ip(F.col("IPV4_DST_ADDR"), F.col("IPV6_DST_ADDR")).alias("IP_DST"),
        *NUMERIC, *scalars.rates("IN"), *scalars.rates("OUT"), *flags, *hot, *[k for k in keep if k in have],
    )
