"""Joins of flows with lists, networks, intervals and packets. Small sides are hinted only where their size is bounded."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalars
from flowmill.session import stored

ADDRESSES = ("IPV4_SRC_ADDR", "IPV4_DST_ADDR", "IPV6_SRC_ADDR", "IPV6_DST_ADDR")
#: Rows a list may have to be broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def allow_list(flows: DataFrame, listed: DataFrame, addresses: tuple[str, ...] = ADDRESSES, ip: str = "ip_address") -> DataFrame:
    """Flows of which any address is listed, however it is spelt. Each flow stays one row."""
    marks = small(listed.select(address_key(F.col(ip)).alias("__ip")).where(F.col("__ip").isNotNull()).distinct())
    hit = F.lit(False)
    for i, c in enumerate(addresses):
        flows = flows.join(marks.select(F.col("__ip").alias(f"__ip{i}")), address_key(F.col(c)) == F.col(f"__ip{i}"), "left")
        hit = hit | F.col(f"__ip{i}").isNotNull()
    return flows.where(hit).drop(*[f"__ip{i}" for i in range(len(addresses))])


def cluster_label(flows: DataFrame, clusters: DataFrame, src: str = "ip_src", dst: str = "ip_dst", ip: str = "ip_address", label: str = "cluster_label") -> DataFrame:
    """Flows of labelled addresses with the source's label, else the destination's."""
    known = small(clusters.groupBy(ip).agg(F.min(label).alias(label)))
    for side, c in (("src", src), ("dst", dst)):
        flows = flows.join(known.select(F.col(ip).alias(f"__{side}"), F.col(label).alias(f"__{side}_label")), F.col(c) == F.col(f"__{side}"), "left").drop(f"__{side}")
    return flows.withColumn(label, F.coalesce("__src_label", "__dst_label")).where(F.col(label).isNotNull()).drop("__src_label", "__dst_label")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the first row per key in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def categorize(rows: DataFrame, categories: DataFrame, ip: str, unknown: str | None = "Unknown") -> DataFrame:
    """Adds `type` by exact address; the first listed type counts. Without a name for the unknown, rows of unlisted addresses go."""
    first = small(first_per_key(categories.select(F.col("ip").alias("__ip"), "type"), ["__ip"], ["type"]))
    if unknown is None:
        return rows.join(first, F.col(ip) == F.col("__ip")).drop("__ip")
    return rows.join(first, F.col(ip) == F.col("__ip"), "left").drop("__ip").withColumn("type", F.coalesce("type", F.lit(unknown)))


def networks(rows: DataFrame, cidr: str = "cidr") -> DataFrame:
    """IPv4 networks as numbers: prefix length, first and last address, IP version. A plain address is a network of 32 bits."""
    parts = F.split(F.col(cidr), "/")
    bits = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(32))
    size = F.expr("shiftleft(cast(1 as bigint), 32 - bits)")
    rows = rows.withColumn("bits", bits).withColumn("__ip", scalars.ipv4_number(F.element_at(parts, 1)))
    return rows.withColumn("low", F.col("__ip") - F.pmod("__ip", size)).withColumn("high", F.col("low") + size - 1).withColumn("version", F.lit(4)).drop("__ip")


def longest_prefix(rows: DataFrame, nets: DataFrame, ip: str, value: str = "type") -> DataFrame:
    """Adds `value` of the most specific network that holds the row's IPv4 address, else null.

    One equality join for each prefix length that occurs (33 at most) on the masked address; no range join. Of equal
    networks the least value counts.
    """
    nets = nets.groupBy("bits", "low").agg(F.min(value).alias("__value"))
    lengths = sorted((r["bits"] for r in nets.select("bits").distinct().collect()), reverse=True)  # 33 at most
    rows, found = rows.withColumn("__n", scalars.ipv4_number(F.col(ip))), []
    for b in lengths:
        part = small(nets.where(F.col("bits") == b).select(F.col("low").alias("__low"), F.col("__value").alias(f"__v{b}")))
        rows = rows.join(part, F.col("__n") - F.pmod("__n", F.lit(1 << (32 - b))) == F.col("__low"), "left").drop("__low")
        found.append(f"__v{b}")
    best = F.coalesce(*found) if len(found) > 1 else F.col(found[0]) if found else F.lit(None).cast("string")
    return rows.withColumn(value, best).drop("__n", *found)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address, however shortened, as 32 hexadecimal digits; a dotted tail counts as two groups. Anything else is null."""
    tail = F.regexp_extract(ip, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    dotted = F.lpad(F.lower(F.hex(scalars.ipv4_number(F.nullif(tail, F.lit(""))))), 8, "0")
    plain = F.when(tail == "", ip).otherwise(F.concat(F.left(ip, F.length(ip) - F.length(tail)), F.left(dotted, F.lit(4)), F.lit(":"), F.right(dotted, F.lit(4))))
    halves = F.split(plain, "::")
    digits = lambda half: F.array_join(F.transform(F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.when(F.length(g) <= 4, F.lpad(F.lower(g), 4, "0")).otherwise(F.lit("!"))), "")
    low, high = digits(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))), digits(F.element_at(halves, 1))
    gap = F.when(F.size(halves) == 2, F.repeat(F.lit("0"), 32 - F.length(high) - F.length(low))).otherwise(F.lit(""))
    out = F.concat(high, gap, low)
    return F.when(ip.contains(":") & out.rlike("^[0-9a-f]{32}$"), out)


def address_key(ip: Column) -> Column:
    """One spelling for an address: an IPv6 one, of which there are many, as hexadecimal digits; anything else as it is."""
    return F.when(ip.contains(":"), F.coalesce(ipv6_hex(ip), ip)).otherwise(ip)


def _prefix6(digits: Column, bits: int) -> Column:
    """The first bits of 32 hexadecimal digits, as digits; the last one masked."""
    whole, rest = divmod(bits, 4)
    if not rest:
        return F.substring(digits, 1, whole)
    last = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(16 - (1 << (4 - rest))))
    return F.concat(F.substring(digits, 1, whole), F.lower(F.hex(last)))


def longest_prefix6(rows: DataFrame, nets: DataFrame, ip: str, value: str = "type", cidr: str = "cidr") -> DataFrame:
    """Adds `value` of the most specific IPv6 network that holds the row's address, else null; other addresses get null.

    One equality join for each prefix length that occurs (129 at most) on the address's first digits. A plain address is a
    network of 128 bits; of equal networks the least value counts.
    """
    parts = F.split(F.col(cidr), "/")
    nets = nets.select(ipv6_hex(F.element_at(parts, 1)).alias("__net"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(128)).alias("__bits"), F.col(value).alias("__value")).where("__net is not null")
    lengths = sorted((r[0] for r in nets.select("__bits").distinct().collect()), reverse=True)  # 129 at most
    rows, found = rows.withColumn("__hex", ipv6_hex(F.col(ip))), []
    for b in lengths:
        part = small(nets.where(F.col("__bits") == b).groupBy(_prefix6(F.col("__net"), b).alias("__low")).agg(F.min("__value").alias(f"__v{b}")))
        rows = rows.join(part, _prefix6(F.col("__hex"), b) == F.col("__low"), "left").drop("__low")
        found.append(F.col(f"__v{b}"))
    return rows.withColumn(value, F.coalesce(*found, F.lit(None).cast("string"))).drop("__hex", *[f"__v{b}" for b in lengths])


def expand_small_networks(nets: DataFrame, host_bits: int = 5) -> DataFrame:
    """Networks with few host bits as one row per address `ip_number`; larger ones stay networks (ip_number null)."""
    few = F.col("bits") >= 32 - host_bits
    return nets.withColumn("ip_number", F.explode(F.when(few, F.sequence("low", "high")).otherwise(F.array(F.lit(None).cast("long")))))


def interval_labels(flows: DataFrame, truth: DataFrame, ip: str = "ip", default: str = "background") -> DataFrame:
    """Label flows that overlap an attack on their source or destination: start <= te and end >= ts (seconds, inclusive).

    Equality on the address with the interval as a residual. A flow that overlaps several attacks, or whose both sides do,
    gives a row for each; one that overlaps none keeps the default label.
    """
    truth = small(truth.select(F.col(ip).alias("__ip"), F.col("label").alias("__label"), "ts", "te"))
    hits = []
    for side in ("ip_src", "ip_dst"):
        overlap = (F.col(side) == F.col("__ip")) & (F.col("start_ms") / 1000 <= F.col("te")) & (F.col("end_ms") / 1000 >= F.col("ts"))
        hits.append(flows.select("flow_id", side, "start_ms", "end_ms").join(truth, overlap).select("flow_id", "__label"))
    labels = hits[0].unionByName(hits[1])
    return flows.join(labels, "flow_id", "left").withColumn("label", F.coalesce("__label", F.lit(default))).drop("__label")


def override_label(flows: DataFrame, addresses: Mapping[str, str], sides: tuple[str, str] = ("ip_src", "ip_dst"), label: str = "label") -> DataFrame:
    """Flows from or to a given address get its label (command and control servers, which no list of attacks has); the last given one counts."""
    out = F.col(label)
    for ip, name in addresses.items():
        hit = F.coalesce((F.col(sides[0]) == ip) | (F.col(sides[1]) == ip), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return flows.withColumn(label, out)


def deny_list(flows: DataFrame, denied: DataFrame, least: int = 4) -> DataFrame:
    """Adds src_deny and dst_deny: listed on the day of the flow's start with a level above `least`; null for an unset address."""
    listed = small(denied.where(F.col("level") > least).select(F.col("day").alias("__day"), F.col("ip").alias("__ip")).distinct().withColumn("__hit", F.lit(True)))
    flows = flows.withColumn("__d", scalars.day_of_month(F.col("start_ms")))
    for side in ("src", "dst"):
        ip = F.col(f"ip_{side}")
        flows = flows.join(listed, (F.col("__d") == F.col("__day")) & (ip == F.col("__ip")), "left")
        unset = ip.isNull() | ip.isin(scalars.NO_IPV4, scalars.NO_IPV6)
        flows = flows.withColumn(f"{side}_deny", F.when(~unset, F.coalesce("__hit", F.lit(False)))).drop("__day", "__ip", "__hit")
    return flows.drop("__d")


FIVE = ("src_ip", "dst_ip", "src_port", "dst_port", "proto")


def packets_in_flows(packets: DataFrame, flows: DataFrame, both_ways: bool = True) -> DataFrame:
    """Packets that belong to a flow: equal 5-tuple (or its reverse) and a time in the flow, its ends widened to whole ms.

    Reversed flows are added to the flows, so the join keeps pure equality keys with the time as a residual.
    """
    spans = flows.select(*FIVE, scalars.floor_millis(F.col("start_s")).alias("__from"), scalars.ceil_millis(F.col("end_s")).alias("__to"))
    if both_ways:
        swap = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port", "proto": "proto"}
        spans = spans.unionByName(spans.select(*[F.col(swap[c]).alias(c) for c in FIVE], "__from", "__to"))
    p, f = packets.alias("p"), spans.alias("f")
    same = [F.col(f"p.{c}") == F.col(f"f.{c}") for c in FIVE]
    return p.join(f, [*same, F.col("p.timestamp").between(F.col("f.__from"), F.col("f.__to"))], "left_semi")


def matching_parameters(rows: DataFrame, parameters: dict) -> DataFrame:
    """Rows whose columns equal the given values; null matches nothing."""
    for column, value in parameters.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def route(flows: DataFrame, inside: DataFrame, ip: str = "ip_address", direction: str | None = None) -> DataFrame:
    """Flows by which side is an inside address: src as they are, dst swapped, both twice (once swapped).

    With a direction column, flows of one inside side are as they are if it is 1 and swapped otherwise, whichever side that is.
    One pass: two existence flags, then each row's one or two orientations.
    """
    known = small(inside.select(F.col(ip).alias("__ip")).distinct().withColumn("__in", F.lit(True)))
    for side in ("src", "dst"):
        flows = flows.join(known.select(F.col("__ip").alias(f"__{side}_ip"), F.col("__in").alias(f"__{side}_in")), F.col(f"ip_{side}") == F.col(f"__{side}_ip"), "left").drop(f"__{side}_ip")
    src, dst = F.col("__src_in").isNotNull(), F.col("__dst_in").isNotNull()
    swap = dst if direction is None else ~F.coalesce(F.col(direction) == 1, F.lit(False))
    ways = F.when(src & dst, F.array(F.lit(False), F.lit(True))).when(src | dst, F.array(swap))
    turned = flows.withColumn("swapped", F.explode(ways)).drop("__src_in", "__dst_in")
    pairs = {c: o for c in turned.columns if (o := scalars.swapped_name(c)) != c and o in turned.columns}
    pairs |= {a: b for a, b in (("ip_src", "ip_dst"), ("ip_dst", "ip_src")) if a in turned.columns and b in turned.columns}
    return turned.select(*[F.when(F.col("swapped"), F.col(pairs[c])).otherwise(F.col(c)).alias(c) if c in pairs else F.col(c) for c in turned.columns])


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pair the rows of two tables of equal length by their place in the given orders.

    Places come from a range sort and the row counts of its partitions, so no task sees a whole table.
    """
    return _placed(left, left_order).join(_placed(right, right_order), "__place").drop("__place")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    # Sorted and written once: the numbering has to see the same rows in both uses.
    ordered = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row per task
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    first = F.create_map(*[F.lit(x) for kv in before for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return ordered.withColumn("__place", F.col("__at").bitwiseAND((1 << 33) - 1) + first[part]).drop("__at")
