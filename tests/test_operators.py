"""Operators against plain Python: ranks without a global window, IPv6 prefixes, networks, the detection chain, samples."""

import ipaddress
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.functions import scalars
from flowmill.operators import joins, ml, profiles, ranks, sampling, scaling


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.choice([5, 5, 5, rng.randrange(-50, 50)])), i, rng.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, id long, w long").repartition(7)
    got = {r.id: r.before for r in ranks.before(df, "v", "w", ["k"], ["id"]).collect()}
    for k in "ab":
        total = 0
        for _, v, i, w in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += w
    assert sorted(r.before for r in ranks.before(df, "v", ties=["id"]).collect()) == list(range(3000))
    points = [0, 0.1, 0.25, 0.5, 0.875, 1]
    for r in ranks.quantiles(df, points, ["k"]).collect():
        assert r.q == pytest.approx(np.quantile([x[1] for x in rows if x[0] == r.k], points))
    assert ranks.before(df.limit(0), "v").count() == 0 and ranks.quantiles(df.limit(0), points, ["k"]).count() == 0


def test_describe_exact_and_by_sketch(spark):
    rng = np.random.default_rng(2)
    x = np.r_[np.zeros(300), rng.normal(10, 3, 700)]
    df = spark.createDataFrame([(float(v), None if i % 9 == 0 else float(i)) for i, v in enumerate(x)], "x double, y double").repartition(5)
    exact, near = ({r.feature: r for r in scaling.describe(df, ["x", "y"], ["x"], exact).collect()} for exact in (True, False))
    want = np.quantile(x[x != 0], [p / 100 for p in scaling.PERCENTILES])
    assert [exact["x"][scaling.percent_key(p)] for p in scaling.PERCENTILES] == pytest.approx(want)
    assert [near["x"][scaling.percent_key(p)] for p in scaling.PERCENTILES] == pytest.approx(want, rel=0.02)
    assert exact["x"].n == 700 and exact["y"].n == 1000 - 112 and exact["x"]["mean"] == pytest.approx(x[x != 0].mean())
    nan = spark.createDataFrame([(float("nan"),), (None,), (4.0,)], "x double")
    config = {"x": {"scaling_type": "minmax", "min": 0.0, "max": 8.0}}
    assert [r.x for r in scaling.scale(nan, config).collect()] == [0.0, 0.0, 0.5]
    kinds = {"norm": (4 - 1) / 8, "bin": 1.0, "identity": 4.0}
    for kind, value in kinds.items():
        config = {"x": {"scaling_type": kind, "min": 0.0, "max": 8.0, "mean": 1.0, "threshold": 3.0}}
        assert [r.x for r in scaling.scale(nan, config).collect()] == [0.0 if kind != "bin" else 1.0, 0.0, value]


def test_ipv6(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        ip = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(64), rng.getrandbits(20) << 108, 0, 1, rng.getrandbits(16) << 64]))
        rows += [(str(ip), ip.exploded.replace(":", "")), (ip.exploded.upper(), ip.exploded.replace(":", ""))]
    rows += [("::ffff:1.2.3.4", "0" * 20 + "ffff01020304"), ("64:ff9b::192.0.2.33", "0064ff9b" + "0" * 16 + "c0000221"), ("10.0.0.1", None), ("no", None), (None, None), ("1:2", None), ("12345::", None)]
    df = spark.createDataFrame(rows, "ip string, want string")
    assert df.where(~joins.ipv6_hex(F.col("ip")).eqNullSafe(F.col("want"))).collect() == []
    nets = [(str(ipaddress.IPv6Network((rng.getrandbits(bits) << (128 - bits), bits))), f"n{i}") for i, bits in enumerate([1, 2, 3, 5, 9, 16, 61, 64, 127, 128, 3])]
    inside = [ipaddress.IPv6Network(c).network_address + rng.getrandbits(128 - int(c.split("/")[1])) if not c.endswith("/128") else ipaddress.IPv6Network(c).network_address for c, _ in nets for _ in range(5)]
    got = joins.longest_prefix6(spark.createDataFrame([(str(ip),) for ip in inside], "ip string"), spark.createDataFrame(nets, "cidr string, type string"), "ip").collect()
    for r in got:
        hits = [(ipaddress.IPv6Network(c).prefixlen, t) for c, t in nets if ipaddress.IPv6Address(r.ip) in ipaddress.IPv6Network(c)]
        longest = max(b for b, _ in hits)
        assert r.type == min(t for b, t in hits if b == longest)


@pytest.mark.parametrize("variational", [True, False])
def test_gradients(variational):
    rng = np.random.default_rng(0)
    model = ml.Autoencoder(6, (5, 4), 3, variational)
    for k in model.p:
        model.p[k] = rng.normal(0, 0.5, model.p[k].shape)
    x, noise = rng.random((8, 6)), rng.normal(size=(8, 3)) if variational else 0.0
    _, grads = model.gradients(x, noise)
    assert set(grads) == set(model.p)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, loss = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                loss.append(model.gradients(x, noise)[0])
            p[at] = old
            assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-3, abs=1e-5), name


def test_losses_add_the_divergence_of_the_batch(spark):
    rng = np.random.default_rng(1)
    x = rng.random((50, 4))
    model = ml.Autoencoder(4, (6,), 2)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, feature array<double>").coalesce(1)
    got = ml.reconstruction_losses(df, model, batch=20).orderBy("i").collect()
    for at in (0, 20, 40):
        mse, bce, kd = model.losses(x[at : at + 20])
        _, (_, mean, spread, _) = model.forward(x[at : at + 20])
        assert kd == pytest.approx(sum(-0.5 * (1 + s - m * m - np.exp(s)) for ms, ss in zip(mean, spread) for m, s in zip(ms, ss)))
        for r, a, b in zip(got[at : at + 20], mse, bce):
            assert (r.mse_loss, r.bce_loss, r.bce_kd_loss) == pytest.approx((a, b, b + kd))


def test_detection_chain_on_models(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        kind = ("background", "background", "scan", "dos")[i % 4]
        base = {"background": (0.2, 0.2), "scan": (0.9, 0.1), "dos": (0.1, 0.9)}[kind]
        rows.append((i, "attack" if kind != "background" else kind, kind, *[min(1.0, max(0.0, b + rng.gauss(0, 0.02))) for b in base]))
    rows += [(5000 + i, "background", "background", 0.95, 0.95) for i in range(5)]  # like nothing else, labelled by nobody
    df = spark.createDataFrame(rows, "flow_id long, label string, kind string, a double, b double")
    train = df.where("flow_id < 5000")
    binary, classes = (ml.train_forest(train, ("a", "b"), c, trees=20, depth=4) for c in ("label", "kind"))
    network = ml.fit_autoencoder(scaling.assemble(train.where("label = 'background'"), ("a", "b")), hidden=(16,), latent=2, epochs=60)
    got = {r.flow_id: r.event_name for r in ml.detection_chain(df, binary, classes, network, ("a", "b")).collect()}
    right = [got.get(i) == (None if kind == "background" else kind) for i, _, kind, *_ in rows if i < 5000]
    assert np.mean(right) > 0.99 and all(got.get(5000 + i) is not None for i in range(5))


def test_balanced_draws(spark):
    rows = [(i, "background" if i < 600 else "scan" if i < 610 else "dos") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(6)
    got = sampling.balanced(df, 200, 7, ["id"]).collect()
    assert Counter(r.label for r in got) == {"background": 400, "scan": 200, "dos": 200}
    label = dict(rows)
    assert all(label[r.id] == r.label and r.binary == (r.label != "background") for r in got)
    assert len({r.id for r in got if r.label == "scan"}) == 10 and len({r.id for r in got if r.label == "background"}) > 250
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.balanced(df.repartition(3), 200, 7, ["id"]).collect()))


@pytest.mark.parametrize("technique", ["mostactive", "leastactive", "random"])
def test_split_addresses(spark, technique):
    rng = random.Random(5)
    rows = [(f"ip{i}", rng.randrange(500, 30_000)) for i in range(400)]
    got = sampling.split_addresses(spark.createDataFrame(rows, "ip string, packets long"), 1000, 20_000, technique).collect()
    kept = {ip: p for ip, p in rows if 1000 <= p <= 20_000}
    assert {r.ip for r in got} == set(kept) and sum(r.part == "test" for r in got) == len(kept) // 4
    if technique != "random":
        order = sorted(kept, key=lambda ip: (kept[ip] * (-1 if technique == "mostactive" else 1), ip))
        assert {r.ip for r in got if r.part == "test"} == set(order[3::4])


def test_few_flows_and_quantile_scaling(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "ip string, num_flows long")
    assert [r.ip for r in profiles.busy_addresses(df).collect()] == ["b"]
    rng = np.random.default_rng(3)
    x = rng.exponential(2, 500)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = np.array([r.x for r in ml.quantile_uniform(rows, ["x"]).collect()[:-1]], float)
    want = np.interp(x, np.quantile(x, np.linspace(0, 1, 1001)), np.linspace(0, 1, 1001))
    assert got == pytest.approx(want, abs=1e-9)


def test_rounding_is_duckdbs(spark):
    import duckdb

    values = [3.5e-05, 6.5e-05, 0.000565, 0.003125, 86211281.956565, -3.5e-05, 2.5e11, 1.7e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (5, 0, -2):
        got = [r.y for r in rows.select(scalars.rounded("x", digits).alias("y")).collect()]
        want = [duckdb.execute(f"SELECT round(CAST(? AS DOUBLE), {digits})", [x]).fetchone()[0] for x in values]
        assert [repr(x + 0.0) for x in got] == [repr(x + 0.0) for x in want]  # zeros without their sign
    assert [r.y for r in rows.limit(1).select(F.round("x", 5).alias("y")).collect()] == [4e-05]  # not so by Spark's round
