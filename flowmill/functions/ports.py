"""Port, protocol, flag and ICMP decoding as column expressions. Everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service ports by category. 22 is a shell port although file transfer uses it too.
PORT_CATEGORIES: dict[str, tuple[int, ...]] = {
    "NOPORT": (0,),
    "WEB_NOENC": (80, 8080),
    "TLS": (443,),
    "DNS": (53,),
    "EMAIL": (25, 26, 109, 110, 143, 209, 218, 220, 465, 587, 993, 995, 2095, 2096),
    "VPN": (500, 1194, 1701, 1723, 4500),
    "DATA": (20, 21, 69, 115, 989, 990, 2077, 2078),
    "SHELL": (22, 23, 513, 514),
    "PLAYSTATION": (3478, 3479, 3480),
    "CHAT": (194, 517, 518, 2351, 6667, 6697),
    "QUERY": (17, 19, 123, 1900, 3283, 4462, 4463, 5683, 6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 11211, 26000),
}
# The same categories as ids, in the order the profiles number them.
CATEGORY_IDS: dict[str, int] = {
    "noport": 0, "noenc_web": 1, "tls": 2, "dns": 3, "email": 4, "vpn": 5, "data": 6, "shell": 7, "playstation": 8, "chat": 9, "query": 10,
    "dynamic": 11, "other": 12,
}
DYNAMIC_FROM = 49152
# Names by protocol number, by ICMP type and by TCP flag bit.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 58: "ICMP6"}
ICMP_TYPES = {0: "ECHO_REPLY", 3: "DEST_UNREACHABLE", 5: "REDIRECT", 8: "ECHO_REQUEST", 11: "TIME_EXCEEDED"}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
# Vocabularies of the one-hot columns.
PROTOCOL_VALUES = ("ICMP", "TCP", "UDP", "GRE", "ESP", "ICMP6")
PORT_VALUES = ("OTHER", "NOPORT", "WEB_NOENC", "TLS", "DNS", "EMAIL", "VPN", "DATA", "SHELL", "PLAYSTATION", "CHAT", "QUERY", "DYNAMIC")
ICMP_VALUES = ("OTHER", "ECHO_REPLY", "DEST_UNREACHABLE", "REDIRECT", "ECHO_REQUEST", "TIME_EXCEEDED")
# The windower's protocol bits; SCTP has none of its own unless strict_compat is off.
PROTOCOL_BITS = {6: 1, 17: 2, 1: 4}
SCTP, SCTP_BIT, OTHER_BIT = 132, 8, 16


def _lookup(value: Column, names: dict, default) -> Column:
    """A CASE over few literals: no join, no user function."""
    out = None
    for key, name in names.items():
        hit = value.isin(*key) if isinstance(key, tuple) else value == key
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(default)


def port_category(port: Column) -> Column:
    """Name of a port's category; unlisted ports from 49152 are DYNAMIC, others OTHER."""
    names = {ports: name for name, ports in PORT_CATEGORIES.items()}
    return _lookup(port, names, F.when(port >= DYNAMIC_FROM, F.lit("DYNAMIC")).otherwise(F.lit("OTHER")))


def port_category_id(port: Column) -> Column:
    """Id 0 to 12 of a port's category."""
    ids = {ports: i for i, ports in enumerate(PORT_CATEGORIES.values())}
    return _lookup(port, ids, F.when(port >= DYNAMIC_FROM, F.lit(CATEGORY_IDS["dynamic"])).otherwise(F.lit(CATEGORY_IDS["other"])))


def protocol_name(protocol: Column) -> Column:
    return _lookup(protocol, PROTOCOLS, F.lit("OTHER"))


def icmp_type_name(icmp: Column) -> Column:
    """ICMP fields hold type * 256 + code; only the type is named."""
    return _lookup(F.floor(icmp / 256), ICMP_TYPES, F.lit("OTHER"))


def protocol_bit(protocol: Column, strict_compat: bool = True) -> Column:
    bits = PROTOCOL_BITS if strict_compat else PROTOCOL_BITS | {SCTP: SCTP_BIT}
    return _lookup(protocol, bits, F.lit(OTHER_BIT))


def flag_bits(flags: Column, prefix: str = "") -> list[Column]:
    """Eight 0/1 columns FIN to CWR, named with an optional prefix such as CLIENT."""
    stem = f"{prefix}_" if prefix else ""
    return [F.shiftright(flags, i).bitwiseAND(F.lit(1)).cast("byte").alias(f"{stem}{name}") for i, name in enumerate(TCP_FLAGS)]


def flag_set(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def one_hot(value: Column, name: str, values: tuple[str, ...]) -> list[Column]:
    """One 0/1 column per value of a fixed vocabulary; an unseen value gives zeros only."""
    return [(value == v).cast("byte").alias(f"{name}_{v}") for v in values]
