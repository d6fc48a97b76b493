"""Per-source tumbling-window statistics with a bounded history of closed windows.

Windows are right-closed, (t0 + kW, t0 + (k+1)W], anchored on the first flow end; the first one includes t0. A late flow is
counted in the window that is current when it arrives. A flow's features summarise its source's closed windows within a
timeout, the last `max_windows` of them, if there are more than `min_windows`; else they are zero.

All steps are aggregations and window frames over (source, window), so the work is partitioned by source and the raw
flows are shuffled once. Names ending in _std inside a window are sample variances, as the model that consumes
the features was trained with; across windows they are population deviations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import ports, scalars


@dataclass(frozen=True)
class Settings:
    """Times in ms. strict_compat counts SCTP as any other protocol and a port sample's unused slots as port 0, as trained models expect.

    A seed makes the port sample a uniform one of `samples` flows; without it all flows are in it. ordered_bpf gives bpf_std as some models
    were trained with it: the running sum, in order of arrival, of (bytes - mean bytes before) (bytes - mean bytes a packet so far).
    """

    window_ms: int = 2000
    min_flows: int = 2
    min_windows: int = 5
    timeout: int = 700
    max_windows: int = 200
    longest_flow_ms: int = 2000
    samples: int = 30
    strict_compat: bool = True
    seed: int | None = None
    ordered_bpf: bool = False


#: Statistics of a closed window that are averaged over windows, in output order; the others have their own summary.
WINDOW_COLUMNS = (
    "flows_total", "flows_concurrent_max", "flows_itimes_avg", "flows_itimes_std", "flows_itimes_min", "flows_itimes_max", "dur_total", "dur_avg",
    "dur_std", "pkt_total", "ppf_avg", "ppf_std", "bytes_total", "bpf_avg", "bpf_std", "bpp_avg", "bpp_std", "bps_avg", "bps_std", "pps_avg",
    "pps_std", "port_src_uniq_cnt", "port_src_entropy", "proto_all_or", "flag_syn_ratio", "flag_ack_ratio", "flag_fin_ratio", "ip_dst_uniq",
    "hdr_payload_ratio_avg", "ttl_std",
)
WHOLE = ("flows_total", "flows_concurrent_max", "pkt_total", "bytes_total", "port_src_uniq_cnt", "proto_all_or", "ip_dst_uniq")
SUMMARY = {"flows_concurrent_max": "max", "flows_itimes_min": "min", "flows_itimes_max": "max", "proto_all_or": "bit_or"}
DEVIATIONS = tuple(c for c in WINDOW_COLUMNS if c not in ("pps_avg", "pps_std", "proto_all_or"))


def flow_features(flows: DataFrame, strict_compat: bool = True) -> DataFrame:
    """Canonical columns of raw flow records for the windower. port_src is the destination port: the windower profiles the service."""
    c = F.col
    ip_src = scalars.unify_ip(c("IPV4_SRC_ADDR"), c("IPV6_SRC_ADDR"))
    seconds = scalars.window_duration(c("FLOW_START_MILLISECONDS"), c("FLOW_END_MILLISECONDS"))
    return flows.select(
        "arrival_seq", ip_src.alias("ip_src"), scalars.unify_ip(c("IPV4_DST_ADDR"), c("IPV6_DST_ADDR")).alias("ip_dst"),
        c("FLOW_START_MILLISECONDS").alias("start_ms"), c("FLOW_END_MILLISECONDS").alias("end_ms"), seconds.alias("dur"),
        c("IN_PKTS").alias("packets"), c("IN_BYTES").alias("bytes"), scalars.per(c("IN_BYTES"), c("IN_PKTS")).alias("bpp"),
        scalars.per(c("IN_BYTES"), seconds).alias("bps"), scalars.per(c("IN_PKTS"), seconds).alias("pps"),
        ports.protocol_bit(c("PROTOCOL"), strict_compat).alias("proto"), c("L4_DST_PORT").alias("port_src"), c("MIN_TTL").alias("ttl"),
        ports.flag_set(c("CLIENT_TCP_FLAGS"), 2).cast("int").alias("syn"), ports.flag_set(c("CLIENT_TCP_FLAGS"), 16).cast("int").alias("ack"),
        ports.flag_set(c("CLIENT_TCP_FLAGS"), 1).cast("int").alias("fin"),
        scalars.header_ratio(ip_src, c("PROTOCOL"), c("IN_PKTS"), c("IN_BYTES"), strict_compat).alias("hdr"),
    )


def assign_windows(flows: DataFrame, window_ms: int, first_ms: int | None = None, late: bool = True, chunk: int = 5_000_000) -> DataFrame:
    """Adds window_id. `first_ms` anchors the grid (default: the least end).

    With `late`, ids are a running maximum in arrival order: per chunk of arrival numbers, with the maximum of the earlier
    chunks from a table of one row per chunk, so no task sees all flows (a trillion of them make 200,000 rows of that table). Without it,
    ids follow each flow's own end.
    """
    if first_ms is None:
        flows = flows.crossJoin(F.broadcast(flows.agg(F.min("end_ms").alias("__t0"))))  # one row
    else:
        flows = flows.withColumn("__t0", F.lit(first_ms))
    own = F.greatest(F.lit(0), F.floor((F.col("end_ms") - F.col("__t0") - 1) / window_ms)).cast("long")
    flows = flows.withColumn("window_id", own).drop("__t0")
    if not late:
        return flows
    flows = flows.withColumn("__chunk", F.floor(F.col("arrival_seq") / chunk))
    earlier = flows.groupBy("__chunk").agg(F.max("window_id").alias("__top"))
    earlier = earlier.withColumn("__before", F.max("__top").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    running = F.max("window_id").over(Window.partitionBy("__chunk").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0))
    flows = flows.withColumn("window_id", running).join(earlier, "__chunk")
    return flows.withColumn("window_id", F.greatest("window_id", F.coalesce("__before", F.lit(0)))).drop("__chunk", "__before")


#: What flows are shuffled and sorted by. The hash is first, as addresses begin alike: nearly all comparisons of a sort end at its eight bytes.
KEYS = ["__key", "ip_src", "window_id"]


def _marked(flows: DataFrame, settings: Settings) -> DataFrame:
    """Two rows a flow, its start with all its columns and its end, beside what its neighbours in (ip_src, window_id) say.

    open: flows open after the event (ends first at ties, so intervals are half-open). gap: seconds since the start before, among
    flows that are not longer than longest_flow_ms. same_port, same_dst: flows of the same port or destination; sampled: whether the
    flow's port is in the port sample, same_sampled: how many of the sample have it. One exchange by KEYS serves all.
    """
    keys = KEYS
    flows = flows.withColumn("__key", F.xxhash64("ip_src", "window_id"))
    event = F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("step"))))
    kept = [c for c in flows.columns if c not in (*keys, "start_ms", "end_ms")]
    rows = flows.withColumn("__short", F.col("end_ms") - F.col("start_ms") <= settings.longest_flow_ms).select(*keys, *kept, "__short", event.alias("e"))
    starts = F.col("step") == 1
    rows = rows.select(*keys, "e.at", "e.step", "__short", *kept).select(*keys, "at", "step", *[F.when(starts, F.col(c)).alias(c) for c in ("__short", *kept)])
    in_time = Window.partitionBy(*keys).orderBy("at", "step")
    short = F.when(F.col("__short"), F.col("at"))
    rows = rows.withColumn("open", F.sum("step").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("gap", (short - F.last(short, True).over(in_time.rowsBetween(Window.unboundedPreceding, -1))) / F.lit(1000.0))
    if settings.seed is None:
        rows = rows.withColumn("sampled", starts)
    else:
        drawn = Window.partitionBy(*keys, "step").orderBy(F.xxhash64(F.lit(settings.seed), "arrival_seq"), "arrival_seq")
        rows = rows.withColumn("sampled", starts & (F.row_number().over(drawn) <= settings.samples))
    if settings.ordered_bpf:
        so_far = Window.partitionBy(*keys, "step").orderBy("arrival_seq")
        before = F.coalesce(F.avg("bytes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumn("bpf_part", (F.col("bytes") - before) * (F.col("bytes") - F.avg("bpp").over(so_far.rowsBetween(Window.unboundedPreceding, 0))))
    by_port = Window.partitionBy(*keys, "port_src")
    rows = rows.withColumn("same_port", F.count_if(starts).over(by_port)).withColumn("same_sampled", F.count_if("sampled").over(by_port))
    rows = rows.withColumn("same_dst", F.count_if(starts).over(Window.partitionBy(*keys, "ip_dst")))
    # Sums of doubles are added in order of arrival, whatever the layout: means that lie on the edge of a rounding stay on one side of it.
    return rows.sortWithinPartitions(*keys, "arrival_seq")


def _port_entropy(settings: Settings) -> Column:
    """Natural-log entropy of the port sample: log N - sum over its flows of log(flows of the same port) / N.

    strict_compat counts the sample's unused slots as port 0 while there are fewer flows than slots. Without a seed all flows
    are counted, with one a uniform sample of as many flows as there are slots.
    """
    used = F.count_if("sampled").cast("double")
    if not settings.strict_compat:
        return F.greatest(F.log(used) - F.sum(F.when(F.col("sampled"), F.log("same_sampled"))) / used, F.lit(0.0))
    spare = F.greatest(F.lit(float(settings.samples)) - used, F.lit(0.0))
    is_zero = F.coalesce(F.col("port_src") == 0, F.lit(False))
    others = F.coalesce(F.sum(F.when(F.col("sampled") & ~is_zero, F.log("same_sampled"))), F.lit(0.0))
    zeros = F.count_if(F.col("sampled") & is_zero) + spare
    return F.greatest(F.log(used + spare) - (others + F.when(zeros > 0, zeros * F.log(zeros)).otherwise(F.lit(0.0))) / (used + spare), F.lit(0.0))


def window_stats(flows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per (ip_src, window_id) with WINDOW_COLUMNS: the flows are shuffled once, and the final aggregation needs no exchange."""
    # The covariance with itself is updated by (x - mean before) (x - mean after), as DuckDB's variance is; var_samp's update has other last bits.
    variance = lambda c: F.coalesce(F.covar_samp(c, c), F.lit(0.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    # Each of n equal values counts 1 / n.
    distinct = lambda c, n: F.round(F.coalesce(F.sum(F.when(F.col(c).isNotNull(), 1 / F.col(n))), F.lit(0.0))).cast("long")
    out = _marked(flows, settings).groupBy(*KEYS).agg(
        F.count_if(F.col("step") == 1).alias("flows_total"), F.greatest(F.max("open"), F.lit(0)).cast("long").alias("flows_concurrent_max"),
        zero(F.avg("gap")).alias("flows_itimes_avg"), zero(F.stddev_samp("gap")).alias("flows_itimes_std"), zero(F.min("gap")).alias("flows_itimes_min"),
        zero(F.max("gap")).alias("flows_itimes_max"), F.sum("dur").alias("dur_total"), F.avg("dur").alias("dur_avg"), variance("dur").alias("dur_std"),
        F.sum("packets").alias("pkt_total"), F.avg("packets").alias("ppf_avg"), variance("packets").alias("ppf_std"),
        F.sum("bytes").alias("bytes_total"), F.avg("bytes").alias("bpf_avg"),
        (F.coalesce(F.try_divide(F.sum("bpf_part"), F.count("bpf_part") - 1), F.lit(0.0)) if settings.ordered_bpf else variance("bytes")).alias("bpf_std"),
        F.avg("bpp").alias("bpp_avg"), variance("bpp").alias("bpp_std"), F.avg("bps").alias("bps_avg"), variance("bps").alias("bps_std"),
        F.avg("pps").alias("pps_avg"), variance("pps").alias("pps_std"), distinct("port_src", "same_port").alias("port_src_uniq_cnt"),
        _port_entropy(settings).alias("port_src_entropy"), F.bit_or("proto").cast("long").alias("proto_all_or"), F.avg("syn").alias("flag_syn_ratio"),
        F.avg("ack").alias("flag_ack_ratio"), F.avg("fin").alias("flag_fin_ratio"), distinct("ip_dst", "same_dst").alias("ip_dst_uniq"),
        F.avg("hdr").alias("hdr_payload_ratio_avg"), variance("ttl").alias("ttl_std"),
    )
    return out.select("ip_src", "window_id", *WINDOW_COLUMNS)


#: Columns whose sums over windows are kept: those with a deviation first.
SUMMED = (*DEVIATIONS, *[c for c in WINDOW_COLUMNS if c not in DEVIATIONS and c not in SUMMARY])
#: Columns that divide by packets, bytes or time, so that a value may be infinite and its variance NaN.
OPEN_ENDED = ("bpp_avg", "bpp_std", "bps_avg", "bps_std", "pps_avg", "pps_std", "hdr_payload_ratio_avg")


def history(stats: DataFrame, settings: Settings = Settings(), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per (ip_src, window_id): the summary of the source's closed windows before it; zeros if there are too few.

    Means and deviations are differences of running sums and sums of squares between the last closed window before and the last
    one too old or beyond max_windows, so a row costs the same however many windows count; only the extremes walk a frame. Sums are decimal,
    of values as shares of the source's greatest, so that the differences are exact, even zero, however large earlier values were. Of
    rates (OPEN_ENDED) windows that aren't finite are counted: an average over them is infinite, and a deviation NaN. Other values that
    aren't finite count as 0. Whole-number statistics are truncated after averaging.

    With `columns`, sums are kept for these alone, and only they are in the result beside window_total, window_span and window_active_ratio.
    """
    wanted = lambda c: columns is None or c in columns
    deviations = [c for c in DEVIATIONS if wanted(f"{c}_std")]
    summed = [*deviations, *[c for c in SUMMED if wanted(c) and c not in deviations and c not in SUMMARY]]
    exact_sums, open_ended = [c for c in WHOLE if wanted(c) and c not in SUMMARY], [c for c in OPEN_ENDED if c in summed]
    listed = lambda found, kind: F.array(*found).cast(f"array<{kind}>")
    whole = len(str(settings.max_windows))
    # A number of windows times their sum of squares has 38 digits at most; with the default limit a hundred million closed windows of a source
    # (six years of two seconds each) can be summed.
    scale = (37 - 2 * whole) // 2
    closed = F.col("flows_total") >= settings.min_flows
    of_ip = Window.partitionBy("ip_src")
    by_ip = of_ip.orderBy("window_id")
    so_far, first = by_ip.rowsBetween(Window.unboundedPreceding, 0), Window.unboundedPreceding
    own = lambda c: F.when(closed & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    rows = stats.withColumns({f"__top_{c}": F.coalesce(F.nullif(F.max(F.abs(own(c))).over(of_ip), F.lit(0.0)), F.lit(1.0)) for c in summed})
    rows = rows.withColumns({f"__own_{c}": F.coalesce(own(c) / F.col(f"__top_{c}"), F.lit(0.0)).cast(f"decimal({scale + 1},{scale})") for c in summed})
    added = lambda x: F.sum(F.when(closed, x)).over(so_far)
    sums = listed([added(F.col(f"__own_{c}")) for c in summed], f"decimal({min(38, scale + 11)},{scale})")
    squares = listed([added(F.col(f"__own_{c}") * F.col(f"__own_{c}")).cast(f"decimal(38,{2 * scale})") for c in deviations], f"decimal(38,{2 * scale})")
    exact = listed([added(F.col(c).cast("long")) for c in exact_sums], "bigint")
    place = F.count_if(closed).over(so_far)
    # Windows whose rate isn't finite; most sources have none, and their rows no array.
    odd = [added(F.when(F.abs(F.col(c)) < float("inf"), 0).when(F.col(c).isNotNull(), 1).otherwise(0)) for c in open_ended]
    # Closed windows have even places, others the odd one after the last closed window, so that a range of places holds a number of closed ones.
    rows = rows.select(
        "ip_src", "window_id", *SUMMARY, listed([F.col(f"__top_{c}") for c in summed], "double").alias("top"), closed.alias("closed"), (2 * place + F.when(closed, 0).otherwise(1)).alias("place"),
        F.when(closed, F.struct(place.alias("n"), sums.alias("s"), squares.alias("q"), exact.alias("w"), F.when(F.greatest(*odd, F.lit(0), F.lit(0)) > 0, listed(odd, "bigint")).alias("o"))).alias("sums"),
    )
    by_place = of_ip.orderBy("place")
    kept = {"id": F.when(F.col("closed"), F.col("window_id"))} | {c: F.when(F.col("closed"), F.col(c)) for c in SUMMARY}
    fold = {"id": F.min} | {c: {"max": F.max, "min": F.min, "bit_or": F.bit_or}[kind] for c, kind in SUMMARY.items()}
    frame = lambda w: F.struct(*[fold[c](x).over(w).alias(c) for c, x in kept.items()])
    last = lambda w: F.last("sums", True).over(w)
    rows = rows.withColumns({"now": last(by_ip.rangeBetween(first, -1)), "old": last(by_ip.rangeBetween(first, -settings.timeout - 1)), "latest": F.max(kept["id"]).over(by_ip.rangeBetween(first, -1)), "timed": frame(by_ip.rangeBetween(-settings.timeout, -1))})
    rows = rows.withColumns({"beyond": last(by_place.rangeBetween(first, -2 * settings.max_windows - 1)), "placed": frame(by_place.rangeBetween(-2 * settings.max_windows, -1))})

    capped = F.coalesce(F.col("now.n") - F.coalesce("old.n", F.lit(0)) > settings.max_windows, F.lit(False))
    rows = rows.select("ip_src", "window_id", "top", "now", "latest", F.when(capped, F.col("beyond")).otherwise(F.col("old")).alias("from"), F.when(capped, F.col("placed")).otherwise(F.col("timed")).alias("seen"))
    rows = rows.withColumn("n", F.coalesce(F.col("now.n") - F.coalesce("from.n", F.lit(0)), F.lit(0)))

    def between(name: str, kind: str) -> Column:
        """What was added to running sums since `from`."""
        return F.transform(F.col(f"now.{name}"), lambda x, i: (x - F.coalesce(F.get(F.col(f"from.{name}"), i), F.lit(0).cast(kind))).cast(kind))

    one, two = f"decimal({whole + scale},{scale})", f"decimal({whole + 2 * scale},{2 * scale})"
    enough = F.col("n") > settings.min_windows
    rows = rows.select("ip_src", "window_id", "top", "n", "seen", "latest", *[F.when(enough, x).alias(c) for c, x in (("s", between("s", one)), ("q", between("q", two)), ("w", between("w", "bigint")), ("o", between("o", "bigint")))])
    n = F.col("n").cast(f"decimal({whole + 1},0)")
    # Differences of 38 digits lose their last one, so what is below it is 0.
    least = F.col("n") * F.lit(10.0 ** (2 - 2 * scale))
    above = lambda x: F.when(x > least, x).otherwise(F.lit(0.0))
    spread = F.transform("q", lambda x, i: F.sqrt(above((n * x - F.get("s", i) * F.get("s", i)).cast("double"))) / F.col("n") * F.get("top", i))
    mean = F.transform("s", lambda x, i: x.cast("double") / F.col("n") * F.get("top", i))
    rows = rows.withColumns({"mean": mean, "spread": spread})

    def unless_odd(c: str, found: Column, instead: float) -> Column:
        return F.when(F.get("o", F.lit(open_ended.index(c))) > 0, F.lit(instead)).otherwise(found) if c in open_ended else found

    def summary(c: str) -> Column:
        if c in SUMMARY:
            out = F.when(enough, F.col(f"seen.{c}"))
        else:
            out = F.col("w")[exact_sums.index(c)] / F.col("n") if c in WHOLE else unless_odd(c, F.col("mean")[summed.index(c)], float("inf") if c.endswith("_avg") else float("nan"))
        return F.coalesce(out.cast("long") if c in WHOLE else out.cast("double"), F.lit(0)).alias(c)

    span = F.when(enough, F.col("latest") - F.col("seen.id") + 1)
    return rows.select(
        "ip_src", "window_id", F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("window_total"), F.coalesce(span, F.lit(0)).alias("window_span"),
        F.coalesce(F.col("n") / span, F.lit(0.0)).alias("window_active_ratio"), *[summary(c) for c in WINDOW_COLUMNS if wanted(c)],
        *[F.coalesce(unless_odd(c, F.col("spread")[i], float("nan")), F.lit(0.0)).alias(f"{c}_std") for i, c in enumerate(deviations)],
    )


def window_features(flows: DataFrame, settings: Settings = Settings(), first_ms: int | None = None, late: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Each flow's arrival_seq, ip_src, window_id and its 58 history features, or window_active_ratio and those named."""
    placed = assign_windows(flows, settings.window_ms, first_ms, late)
    past = history(window_stats(placed, settings), settings, columns)
    return placed.select("arrival_seq", "ip_src", "window_id").join(past, ["ip_src", "window_id"]).drop("window_total", "window_span")
