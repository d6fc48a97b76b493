import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowmill.llm import lm_score


def spell(token):
    return token if token == b"\n" else token + b" "


def brute(texts):
    """Counts by context for all orders, and a coder that follows the definition symbol by symbol."""
    tries = defaultdict(Counter)

    def steps(words):
        past = b" " * lm_score.ORDER
        for x in b"".join(map(spell, words)):
            yield past, x
            past = past[1:] + bytes([x])

    for words in texts:
        for past, x in steps(words):
            for k in range(lm_score.ORDER + 1):
                tries[past[len(past) - k :]][x] += 1

    def code(words):
        out = 0.0
        for past, x in steps(words):
            ruled_out = set()
            for k in range(lm_score.ORDER, -1, -1):
                follow = {s: c for s, c in tries.get(past[len(past) - k :], {}).items() if s not in ruled_out}
                if not follow:
                    continue
                total, distinct = sum(follow.values()), len(follow)
                if x in follow:
                    out += math.log10((follow[x] - 0.5) / total)
                    break
                out += math.log10(distinct / (2 * total))
                ruled_out |= set(follow)
            else:
                out -= math.log10(256 - len(ruled_out))
        return out

    return code


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ab", "Ba", "c", "é", "dd"]) for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)] + [(70, None), (71, ""), (72, "\t x\n"), (None, "ab"), (3, "ab ab"), (3, "ab ab"), (80, "Zq" * 500)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, kind string").repartition(3)
    got = lm_score.ppm_scores(df).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t in rows if not held(i) for w in lm_score.tokens(t))
    code = brute([lm_score.tokens(t) for i, t in rows if not held(i)])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        ws = lm_score.tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        want.append((-1 if i is None else i, held(i), len(ws), sum(train[w] > 0 for w in ws), n, base, code(ws)))
    have = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_pieces_of_a_body_have_its_grams():
    body = lm_score.spelt(lm_score.tokens("some Text that is cut " * 40))
    whole = lm_score.grams(list(lm_score.pieces(body, len(body))))
    for size in (1, 5, 6, 7, 100):
        assert (lm_score.grams(list(lm_score.pieces(body, size))) == whole).all()
    assert len(whole) == len(body)


def test_words_of_equal_hash_are_in_order(monkeypatch):
    monkeypatch.setattr(lm_score.zlib, "crc32", lambda w: len(w))
    words = [b"bb", b"c", b"aa", b"ab", b"c", b"ba", b"a"]
    ranked, hashes, place = lm_score._ranked(pa.chunked_array([pa.array(words[:3], pa.binary()), pa.array(words[3:], pa.binary())]))
    assert ranked == [b"a", b"c", b"aa", b"ab", b"ba", b"bb"] and hashes.tolist() == [1, 1, 2, 2, 2, 2] and [ranked[i] for i in place] == words


def test_very_long_text(spark):
    """A text of several pieces, beside others, against the trie in one process."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma", "delta", "épsilon"]) for _ in range(n)) for n in (500_000, 10, 0)]
    got = {r.doc_id: r for r in lm_score.ppm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), held_out=F.lit(False)).collect()}
    bodies = [lm_score.spelt(lm_score.tokens(t)) for t in texts]
    each = [lm_score.grams(list(lm_score.pieces(b, 1 << 30))) for b in bodies]
    keys, counts = np.unique(np.concatenate(each), return_counts=True)
    near = ((keys >> np.uint64(32)) * lm_score._GATHER & lm_score._24).astype(np.int64)
    ids, at = np.unique(near >> 8 << 8 | (keys & np.uint64(255)).astype(np.int64), return_inverse=True)
    codes = lm_score.Trie(ids, np.bincount(at, counts)).codes(keys, counts.astype(float))
    for i, g in enumerate(each):
        assert got[i].score == pytest.approx(codes[np.searchsorted(keys, g)].sum(), rel=1e-5) and got[i].n_tokens == got[i].n_known == len(lm_score.tokens(texts[i]))


def test_probabilities_sum_to_one_at_most():
    code = brute([[b"ab", b"abc", b"b", b"\n"]])
    assert sum(10 ** code([bytes([x]), b"\n"]) for x in range(256) if x not in b" \t\n\r\x0b\x0c") < 1


def test_without_training_rows_and_empty(spark):
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = lm_score.ppm_scores(one, held_out=F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert row.score == pytest.approx(-4 * math.log10(256))
    assert lm_score.ppm_scores(one.limit(0)).count() == 0
