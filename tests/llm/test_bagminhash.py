import random
from collections import Counter

import numpy as np
import pytest

from flowmill.llm import bagminhash as bag
from flowmill.llm import common


def multiset(text):
    words = (text or "").split()
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(60):
        h = rng.integers(1, 2**63, 60).astype(np.uint64)
        h.sort()
        pairs += [(h[:50], rng.integers(1, 40, 50)), (h[10:], rng.integers(1, 9, 50))]
    tags = bag.signatures(pairs)
    want, got = [], []
    for i in range(0, len(pairs), 2):
        a, b = (dict(zip(h.tolist(), c.tolist())) for h, c in pairs[i : i + 2])
        want.append(sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b))
        got.append((tags[i] == tags[i + 1]).mean())
    want, got = np.array(want), np.array(got)
    assert abs(want.mean() - got.mean()) < 3 * (want * (1 - want) / bag.M).mean() ** 0.5 / len(want) ** 0.5
    assert np.abs(want - got).max() < 5 * 0.5 / bag.M**0.5


def test_heavy_weights_are_consistent():
    h = np.array([5, 9], np.uint64)
    a, b, c = bag.signatures([(h, np.array([1000, 1])), (h, np.array([900, 1])), (h, np.array([1000, 1]))])
    assert (a == c).all() and abs((a == b).mean() - 901 / 1001) < 0.12


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randrange(1, 200)))) for i in range(60)]
    origin = text(150)
    for i in range(60):  # a group of near copies, larger than a small bucket
        copy = list(origin)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    shared = text(120)
    for i in range(40):  # a passage that dissimilar texts share, some in similar pairs
        own = text(rng.randrange(60, 90))
        rows.append((200 + 2 * i, " ".join(shared + own)))
        if i % 4 == 0:
            own[-1] = "changed"
            rows.append((201 + 2 * i, " ".join(shared + own)))
    rows += [(400 + i, rows[3][1]) for i in range(20)] + [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "two  words"), (505, "a b c d"), (None, rows[3][1])]
    rows += [(600, "x " * 300), (601, "x " * 290), (602, "x " * 200), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("limit", [None, 0])
def test_classes_equal_brute_force(spark, monkeypatch, limit):
    if limit is not None:  # groups joined by shuffle, their rows dealt
        monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, rep int, bands string").repartition(4)
    got = bag.near_groups(df).collect()
    assert len(got) == len(rows)
    keys = [" ".join((t or "").split()) for _, t in rows]
    bags = {k: multiset(k) for k in keys}
    distinct = list(bags)
    root = {k: k for k in distinct}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bags[a] and similarity(bags[a], bags[b]) >= 0.8:
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    classes = {}
    for (doc, _), k in zip(rows, keys):
        classes.setdefault(find(k), []).append(doc)
    want = sorted((doc is None, doc, min(x for x in c if x is not None), len(c)) for c in classes.values() for doc in c)
    assert sorted((r.doc_id is None, r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)
    # A text's links are to different texts and found ones only; each class is connected by them.
    key_of = {}
    for (doc, _), k in zip(rows, keys):
        key_of.setdefault(doc, set()).add(k)
    for r in got:
        assert any(r.n_links <= links[k] and (r.n_links > 0) == (links[k] > 0) for k in key_of[r.doc_id]), r
    kept = bag.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(classes)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (50, 51)], [(0, i) for i in range(1, 30)]])
@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, edges, few):
    got = dict(bag.components(spark.createDataFrame(edges, "a long, b long"), few).collect())
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_empty(spark):
    assert bag.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_among_many_texts_that_share_a_passage(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200_000)]
    passage = [rng.choice(words) for _ in range(154)]  # 150 shingles
    rows = []
    for i in range(300):  # 0.76 to 0.79 with each other
        own = [rng.choice(words) for _ in range(20 + i % 4)]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:  # 0.81 or more with its own pair alone
            rows.append((2 * i + 1, " ".join(passage + own[:5] + [rng.choice(words) for _ in own[5:]])))
    bags = {i: multiset(t) for i, t in rows}
    want = {(a, b) for b in bags for a in bags if a < b and similarity(bags[a], bags[b]) >= 0.8}
    assert want == {(2 * i, 2 * i + 1) for i in range(0, 300, 3)}
    got = {}
    for r in bag.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert {tuple(sorted(c)) for c in got.values() if len(c) > 1} == want
