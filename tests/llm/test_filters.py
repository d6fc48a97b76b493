import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import common, exact_dedup, mixing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_groups(spark, monkeypatch):
    long = "z" * 1000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long[:-1] + "y"), (7, long), (7, long), (8, "é"), (None, "a"), (None, "solo"), (9, "b"), (10, " a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, head string, rid int").repartition(3)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted((i is None, i or 0, max((x for x in g if x is not None), default=None) or -1, len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    for limit in (exact_dedup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", limit)
        monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
        got = exact_dedup.exact_groups(df, digest_all=True).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups) and all(r.kept <= (r.doc_id == r.keep_id) for r in got)
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns and Counter(r.text or "" for r in kept.collect()) == Counter(list(groups))
    monkeypatch.undo()
    assert exact_dedup.exact_groups(df).where("text_sha256 is null").count() == 4
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not above:
            return out
        capped |= above


def test_mix(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", "Z", "é", "hot", "hot", "hot", None]), " w" * rng.randrange(200)) for i in range(3000)] + [(-1, "none", None), (-1, "none", None), (None, "a", "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, target int").repartition(3)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    for limit in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r["__target"] == pytest.approx(want[r.source]) and r["__source_size"] == sizes[r.source] and 0 <= r["__copies"] <= 2
            taken[r.source] += r["__copies"] * r["__size"]
        for s in sizes:
            assert taken[s] == pytest.approx(want[s], rel=0.12), s
    mixed = mixing.mix(df)
    assert sorted(mixing.emit(mixed).groupBy("doc_id").count().where("doc_id >= 0").collect()) == sorted((r.doc_id, r["__copies"]) for r in got if r.doc_id is not None and r.doc_id >= 0 and r["__copies"])
    assert mixing.emit(mixed).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def brute(text):
    words, n_dup, seen = WORD.findall(text or ""), 0, set()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(marked)


def test_quality(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "x " * 40, "a b c d e f g h a b c d e f g h", "é|é #\x0b\x0c\r\nz q", "l1 w\n\nl1 w\n \nl1 w \nl1 w", "the cat sat " * 3000]
    texts += ["".join(rng.choice(["a", "b", "the", "é", "#"]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    judged = quality.judge(df)
    assert "PythonUDF" not in judged._jdf.queryExecution().toString() and "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
    for r in judged.collect():
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) == brute(r.text), repr(r.text)[:200]
        assert r["__passes"] == verdict(r.text), repr(r.text)[:200]
    assert quality.judge(df.limit(0)).count() == 0


def verdict(text):
    """The production rules, plainly."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars, symbols, dup, again = brute(text)
    per = lambda a, b: a / b if b else 0.0
    stop = {*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return (
        n >= 20 and 2 <= per(chars, n) <= 14 and per(symbols, n) <= 0.1 and per(dup, len(lines)) <= 0.3 and per(again, n) <= 0.3
        and per(stutter, n) <= 0.3 and per(sum(w in stop for w in words), n) >= 0.02
    )


def test_quality_verdicts(spark):
    rng = random.Random(12)
    good = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):  # around each threshold: length, word length, symbols, copies of lines, stutter, function words
        words = [rng.choice(good) for _ in range(rng.randrange(15, 60))] + ["The", "von"] * rng.randrange(3)
        words += [rng.choice(["x" * 60, "#", "a"]) for _ in range(rng.choice([0, 0, 4, 12]))]
        words += ["echo"] * rng.choice([0, 0, 10, 40])
        rng.shuffle(words)
        text = " ".join(words)
        rows.append((i, "\n".join([text] * rng.choice([1, 1, 2]) + ["line the"] * rng.choice([0, 2, 9]))))
    rows += [(900, "the word " * 40_000), (901, None), (901, None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, __m int, stop_ratio double")
    got = [(r.text, r["__passes"]) for r in quality.judge(df).collect()]
    assert len(got) == len(rows) and 20 < sum(p for _, p in got) < 280
    assert all(p == verdict(t) for t, p in got)


def test_machine_learns_a_pair(spark):
    """Neither term alone tells: only both together are toxic."""
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))] + ["Insult!"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "insult group", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (17, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r["__score"] for r in toxicity.score(docs, machine).collect()}
    hit = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if toxicity.zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(hit) > 0.98 and got[5000] == got[5001] < 0.3 and got[None] > 0.5
    kept = toxicity.drop_toxic(docs, machine, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(x < 0.5 for x in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r["__score"], 6) for r in toxicity.score(docs, none).collect()} == {round(1 / (1 + np.exp(-none.bias)), 6)}
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    slots = np.zeros(1 << toxicity.BITS, np.int32)
    slots[:50] = np.arange(1, 51)
    machine = toxicity.Machine(-0.7, slots, np.r_[0.0, rng.normal(0, 0.3, 50)], np.vstack([np.zeros((1, toxicity.FACTORS)), rng.normal(0, 0.3, (50, toxicity.FACTORS))]))
    for size in (0, 1, 2, 7, 30):
        terms = rng.choice(200, size, replace=False).astype(np.uint32)
        z = machine.bias
        for a, i in enumerate(terms):
            z += machine.w[slots[i]]
            for j in terms[:a]:
                z += machine.v[slots[i]] @ machine.v[slots[j]]
        assert machine.score(terms) == pytest.approx(1 / (1 + np.exp(-z)))


def test_term_that_tells_only_beside_another(spark):
    """`them` is as common in toxic texts as in others: it turns one insult toxic and the other harmless."""
    rng, filler, rows = random.Random(6), [f"w{i}" for i in range(300)], []
    for i in range(6000):
        one, other, them = rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(20)] + ["scum"] * one + ["rogue"] * other + ["them"] * them
        # `scum` is toxic with `them` and `rogue` without, so that neither is as common in toxic texts as in others.
        rows.append((i, " ".join(words), int((one and them) or (other and not them))))
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flat = [(toxicity.terms_of(t).astype(np.int32).tolist(), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    kept = toxicity.related(spark.createDataFrame([(y, t) for t, y in flat], "label int, terms array<int>"))
    them = int(toxicity.terms_of("them")[0])
    alone = [(them in t, y) for t, y in flat]
    n, seen, pos, both = len(alone), sum(a for a, _ in alone), sum(y for _, y in alone), sum(a and y for a, y in alone)
    cells = [(both, seen * pos / n), (seen - both, seen * (n - pos) / n), (pos - both, (n - seen) * pos / n), (n - pos - seen + both, (n - seen) * (n - pos) / n)]
    assert 2 * sum(g * np.log(g / w) for g, w in cells) < toxicity.LEAST_RATIO and them in kept
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r["__score"] for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()
