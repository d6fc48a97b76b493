import itertools
import random
import time

import numpy as np
import pytest

from flowmill.llm import pii


def test_plain_patterns():
    text = "a.b@x-y.co.uk, c@d e@f.g 1.2.3.4; 1.2.3.400; 4111 1111 1111 1111; 4111111111111112; +1 (988) 555-2485; +12 34"
    got = [(k, text[a:b]) for k, a, b in pii.plain_spans(text)]
    assert got == [("email", "a.b@x-y.co.uk"), ("email", "e@f.g"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert pii.plain_spans("4111 1111 1111 1111 4111111111111111") == []  # one match of 32 digits fails; no retry


def test_gates_lose_no_match():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("0123456789 .-+@ab()") for _ in range(rng.randrange(60)))
        plain = [(k, m.start(), m.end()) for k in pii.KINDS for m in pii.PATTERNS[k].finditer(text) if pii._valid(k, m[0])]
        assert pii.plain_spans(text) == plain


def test_long_runs_take_linear_time():
    began = time.monotonic()
    n = 1_000_000
    assert pii.plain_spans("7" * n + " . ") == [] and pii.plain_spans("a" * n) == [] and pii.plain_spans("+1" + " " * n) == []
    assert pii.plain_spans("a" * n + "@b.cd") == [("email", 0, n + 5)] and pii.plain_spans("a@" + "b" * n) == []
    assert pii.plain_spans("1." * n) == [("ip", i, i + 7) for i in range(0, 2 * n - 7, 8)]
    assert pii.plain_spans("9" * 5000 + ".1.1.1") == [] and pii.plain_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.plain_spans("@" * n) == [] and pii.plain_spans("a@b.c" * (n // 5)) and pii.plain_spans("+1(" * (n // 3)) == []
    assert time.monotonic() - began < 30


def test_sums_and_best_paths_equal_enumeration():
    rng = np.random.default_rng(4)
    model = pii.Tagger(2)
    for name in ("trans", "out", "bias"):
        model.p[name] = rng.normal(0, 1, model.p[name].shape)
    ids, tags, n = rng.integers(0, 60, (3, 4)), rng.integers(0, len(pii.TAGS), (3, 4)), len(pii.TAGS)
    e, _ = model.emissions(ids)
    paths = np.array(list(itertools.product(range(n), repeat=4)))
    loss = 0.0
    for b in range(3):
        score = e[np.arange(4), b, paths].sum(1) + model.p["trans"][paths[:, :-1], paths[:, 1:]].sum(1)
        gold = score[(paths == tags[b]).all(1)][0]
        loss += np.log(np.exp(score).sum()) - gold
        allowed = ~(model.banned[paths[:, :-1], paths[:, 1:]].any(1) | model.no_start[paths[:, 0]])
        assert (model.decode(ids)[b] == paths[np.where(allowed, score, -np.inf).argmax()]).all()
    assert model.step(ids, tags)[0] == pytest.approx(loss / 3)


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger(1)
    ids, tags = rng.integers(0, 60, (3, 7)), rng.integers(0, len(pii.TAGS), (3, 7))
    _, grads = model.step(ids, tags)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if name == "embed":
                at = (int(ids[0, 3]), at[1])
            old = p[at]
            p[at] = old + 1e-5
            up, _ = model.step(ids, tags)
            p[at] = old - 1e-5
            down, _ = model.step(ids, tags)
            p[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name


@pytest.fixture(scope="module")
def model():
    return pii.default_tagger()


def test_held_out_accuracy(model):
    rng, hit, missed, wrong = random.Random(99), 0, 0, 0
    for _ in range(150):
        text, spans = pii.example(rng)
        base = pii.plain_spans(text)
        got, want = set(base) | set(pii.added_spans(text, base, model)), set(spans)
        hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.95


def test_windows_are_reconciled(model):
    for pad in range(0, 140, 7):
        text = "lorem " * 40 + "x" * (pad % 5) + " ipsum" * (pad // 6) + " jane.doe (at) mail.example.com dolor sit. " + "amet " * 60
        assert [text[a:b] for _, a, b in pii.added_spans(text, [], model)] == ["jane.doe (at) mail.example.com"]
    assert pii.added_spans("no trigger here " * 1000, [], model) == []


LONG = (
    "maximiliane.featherstone_99 (at) correspondence-mail.example.org", "maximiliane.featherstone_99 (at) mail.correspondence.department.example.org",
    "john_featherstonehaugh [at] correspondence-department (dot) international-example (dot) org",
)


@pytest.mark.parametrize("span", LONG)
def test_long_spans_are_seen_whole_at_every_offset(model, span):
    """If the network takes a span whole at all, it does so wherever the grid of windows cuts the text."""
    assert 60 <= len(span) <= pii.WINDOW - pii.STRIDE
    for pad in range(pii.STRIDE):
        text = ("lorem ipsum " * 30)[pad:] + span + " dolor sit " * 30
        assert [text[a:b] for _, a, b in pii.added_spans(text, [], model)] == [span], pad


def test_frames(spark, model):
    rows = [(1, "mail a@b.cd or 988-555-2485 now"), (1, "mail a@b.cd or 988-555-2485 now"), (2, None), (3, ""), (None, "1.2.3.4"), (4, "word " * 100_000 + "a@b.cd")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, base string, kind int")
    got = pii.find_pii(df, redacted=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].redacted == "mail <email> or <phone> now" and by[2].base == [] and by[3].added == [] and by[2].redacted == ""
    assert tuple(by[4].base[0]) == ("email", 500_000, 500_006) and by[None].base[0].kind == "ip"
    assert pii.find_pii(df.limit(0)).count() == 0
