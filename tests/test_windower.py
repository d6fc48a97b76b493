"""The windower against a small sequential model, written independently, and its invariance to layout."""

import math
import random
from collections import Counter, defaultdict

import pytest

from flowmill.operators import windower as w

SETTINGS = w.Settings(window_ms=1000, min_flows=2, min_windows=2, timeout=12, max_windows=5, longest_flow_ms=800)


def sequential(flows, s):
    """Flow by flow in arrival order: close windows when the clock passes them, and summarise what is closed."""
    t0 = min(f["end_ms"] for f in flows)
    current, open_now, closed, out = 0, defaultdict(list), defaultdict(list), {}
    ids = {}
    for f in sorted(flows, key=lambda f: f["arrival_seq"]):
        window = max(0, math.ceil((f["end_ms"] - t0) / s.window_ms) - 1)
        if window > current:
            for ip, own in open_now.items():
                if len(own) >= s.min_flows:
                    closed[ip].append((current, stats(own, s)))
            open_now.clear()
            current = window
        open_now[f["ip_src"]].append(f)
        ids[f["arrival_seq"]] = current
        past = [x for x in closed[f["ip_src"]] if current - x[0] <= s.timeout][-s.max_windows :]
        out[f["arrival_seq"]] = summary(past) if len(past) > s.min_windows else None
    return ids, out


def stats(own, s):
    starts = sorted(f["start_ms"] for f in own if f["end_ms"] - f["start_ms"] <= s.longest_flow_ms)
    gaps = [(b - a) / 1000 for a, b in zip(starts, starts[1:])]
    steps, n, most = sorted([(f["start_ms"], 1) for f in own] + [(f["end_ms"], -1) for f in own]), 0, 0
    for _, step in steps:
        n += step
        most = max(most, n)
    slots = Counter([f["port_src"] for f in own])
    if len(own) < s.samples:
        slots[0] += s.samples - len(own)
    total = sum(slots.values())
    mean = lambda v: sum(v) / len(v)
    sizes = [f["bytes"] for f in own]
    spread = lambda v: sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1) if len(v) > 1 else 0.0
    proto = 0
    for f in own:
        proto |= f["proto"]
    return {
        "flows_total": len(own), "flows_concurrent_max": most, "flows_itimes_avg": mean(gaps) if gaps else 0.0, "flows_itimes_std": math.sqrt(spread(gaps)) if gaps else 0.0,
        "flows_itimes_min": min(gaps, default=0.0), "flows_itimes_max": max(gaps, default=0.0), "bytes_total": sum(sizes), "bpf_std": spread(sizes), "proto_all_or": proto,
        "port_src_uniq_cnt": len({f["port_src"] for f in own}), "port_src_entropy": -sum(c / total * math.log(c / total) for c in slots.values()),
        "ip_dst_uniq": len({f["ip_dst"] for f in own}), "flag_syn_ratio": mean([f["syn"] for f in own]),
    }


def summary(past):
    rows = [x[1] for x in past]
    mean = lambda v: sum(v) / len(v)
    pop = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))
    out = {}
    for c in rows[0]:
        v = [r[c] for r in rows]
        out[c] = max(v) if c in ("flows_concurrent_max", "flows_itimes_max") else min(v) if c == "flows_itimes_min" else mean(v)
        if c == "proto_all_or":
            out[c] = 0
            for x in v:
                out[c] |= x
        if c in w.WHOLE:
            out[c] = int(out[c])
        if c != "proto_all_or":
            out[f"{c}_std"] = pop(v)
    out["window_active_ratio"] = len(past) / (past[-1][0] - past[0][0] + 1)
    return out


def flows(seed, n=700):
    rng, out, clock = random.Random(seed), [], 10_000
    for i in range(n):
        clock += rng.choice([0, 5, 40, 300, 300, 900 if rng.random() < 0.9 else 9000])
        end = clock - (rng.randrange(4000) if rng.random() < 0.15 else 0)
        start = end - rng.choice([0, 0, 10, 500, 1500])
        packets, size = rng.randrange(1, 9), rng.randrange(40, 900)
        out.append({"arrival_seq": i, "ip_src": f"10.0.0.{rng.randrange(4)}", "ip_dst": f"10.1.0.{rng.randrange(5)}", "start_ms": start, "end_ms": end, "dur": max(end - start, 10) / 1000.0, "packets": packets,
                    "bytes": size, "bpp": size / packets, "bps": 1.0 * size, "pps": 1.0, "proto": rng.choice([1, 2, 4, 16]), "port_src": rng.choice([0, 80, 443, 53]), "ttl": 64, "syn": rng.randrange(2), "ack": 0, "fin": 1, "hdr": 0.5})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_sequential_model(spark, seed):
    rows = flows(seed)
    ids, want = sequential(rows, SETTINGS)
    got = {r.arrival_seq: r for r in w.window_features(frame(spark, rows), SETTINGS).collect()}
    assert len(got) == len(rows) and sum(x is not None for x in want.values()) > 100
    for i, r in got.items():
        assert r.window_id == ids[i]
        if want[i] is None:
            assert all(v == 0 for v in r[3:])
        else:
            for c, v in want[i].items():
                assert r[c] == pytest.approx(v, rel=1e-6, abs=1e-9), (i, c)


def test_ordered_variance_and_port_sample(spark):
    rows = flows(5, 200)
    settings = w.Settings(window_ms=60_000, samples=8, strict_compat=False, seed=3, ordered_bpf=True)
    placed = w.assign_windows(frame(spark, rows), settings.window_ms)
    window_of = {r.arrival_seq: (r.ip_src, r.window_id) for r in placed.collect()}
    own = defaultdict(list)
    for f in rows:
        own[window_of[f["arrival_seq"]]].append(f)
    for r in w.window_stats(placed, settings).collect():
        total, sizes, ratios = 0.0, [], []
        for f in own[r.ip_src, r.window_id]:
            ratios.append(f["bpp"])
            total += (f["bytes"] - (sum(sizes) / len(sizes) if sizes else 0)) * (f["bytes"] - sum(ratios) / len(ratios))
            sizes.append(f["bytes"])
        n = len(sizes)
        assert r.bpf_std == pytest.approx(total / (n - 1) if n > 1 else 0.0) and r.flows_total == n
        assert r.port_src_uniq_cnt == len({f["port_src"] for f in own[r.ip_src, r.window_id]}) and 0 <= r.port_src_entropy <= math.log(min(n, 8)) + 1e-9
    a, b = (sorted(w.window_stats(placed.repartition(n), settings).select("ip_src", "window_id", "port_src_entropy").collect()) for n in (1, 7))
    assert [r[:2] for r in a] == [r[:2] for r in b] and [r[2] for r in a] == pytest.approx([r[2] for r in b])


def test_layout_changes_nothing(spark):
    rows = flows(3, 300)
    shuffled = random.Random(0).sample(rows, len(rows))
    settle = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = settle(w.window_features(frame(spark, rows).repartition(1), SETTINGS))
    assert settle(w.window_features(frame(spark, shuffled).repartition(13), SETTINGS)) == want


def test_boundaries(spark):
    rows = [(0, 1000), (1, 2000), (2, 2001), (3, 9000), (4, 1500)]
    df = spark.createDataFrame(rows, "arrival_seq long, end_ms long")
    for chunk in (1, 2, 100):
        assert [r.window_id for r in w.assign_windows(df, 1000, chunk=chunk).orderBy("arrival_seq").collect()] == [0, 0, 1, 7, 7]
    assert [r.window_id for r in w.assign_windows(df, 1000, first_ms=0, late=False).orderBy("arrival_seq").collect()] == [0, 1, 2, 8, 1]


def test_58_features():
    assert len(w.WINDOW_COLUMNS) + len(w.DEVIATIONS) + 1 == 58


def test_infinite_rates_of_past_windows(spark):
    """A window with a flow of no bytes: averages over it are infinite and deviations NaN, others stay as they are."""
    rows = [dict(r, ip_src="10.0.0.1", hdr=math.inf if r["arrival_seq"] == 200 else r["hdr"]) for r in flows(3)]
    ids, want = sequential([dict(r, hdr=0.5) for r in rows], SETTINGS)
    got = w.window_features(frame(spark, rows), SETTINGS).collect()
    hit = [r for r in got if r.hdr_payload_ratio_avg == math.inf]
    assert hit and all(math.isnan(r.hdr_payload_ratio_avg_std) for r in hit) and min(r.window_id for r in hit) > ids[200]
    plain = [r for r in got if want[r.arrival_seq] is not None and r.hdr_payload_ratio_avg != math.inf]
    assert plain and all(r.hdr_payload_ratio_avg == pytest.approx(0.5) and r.hdr_payload_ratio_avg_std == pytest.approx(0, abs=1e-9) for r in plain)


def test_sums_are_added_in_order_of_arrival(spark):
    """The mean of 1e16, 1, -1e16 depends on the order of adding; whatever the layout, it is the order of arrival."""
    rows = [dict(r, ip_src="10.0.0.1", ip_dst=f"10.1.0.{3 - i}", port_src=90 - i, start_ms=100 - i, end_ms=200, bpp=(1e16, -1e16, 1.0)[i]) for i, r in enumerate(flows(1)[:3])]
    for order in (rows, rows[::-1]):
        got = w.window_stats(w.assign_windows(frame(spark, order), 2000, 0), SETTINGS).first()
        assert got.bpp_avg == pytest.approx(1 / 3)
