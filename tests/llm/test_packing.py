import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowmill.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b ", "x\n\ny", "a\tb\r\n c", "don't we'll I'M", "é è ü　 z", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d a \x85b", "12 345,6!? ..", " lead", "trail \n", "日本語 テキスト 😀😀"]


def test_ids_equal_the_tokenizers_library():
    plain = Tokenizer.from_file(PATH)
    encode = tokens.encoder(PATH).encode
    rng = random.Random(1)
    chars = "ab é'st \n\t x1.#"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(400)]
    for text in texts:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    rng = random.Random(2)
    text = "".join(rng.choice("abc  \n.é'") for _ in range(5000))
    assert tokens.encoder(PATH).encode(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_best_fit_equals_a_plain_search():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(80))]
        open_windows, plain = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in open_windows if r >= lengths[i]]
            if fits:
                open_windows[open_windows.index(min(fits))] -= lengths[i]
            else:
                open_windows.append(64 - lengths[i])
        found = packing.best_fit_decreasing(lengths, 64)
        used = {}
        for (w, at), n in zip(found, lengths):
            plain.append((w, at, n))
            used[w] = used.get(w, 0) + n
        assert sorted(64 - x for x in used.values()) == sorted(open_windows)
        for w in used:
            end = 0
            for _, at, n in sorted(x for x in plain if x[0] == w):
                assert at == end
                end += n
            assert end <= 64


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "no id")]
    rows += [(200 + i, " ".join(rng.choice(["alpha", "be", "gamma,", "δ"]) for _ in range(rng.randrange(2000)))) for i in range(60)]
    return spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, sequence_id string, offset int").repartition(3)


def test_pieces(docs):
    plain = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id is None, r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect() if r.doc_id != 100 and r.doc_id is not None)
    got = packing.pack_pieces(docs, PATH).collect()
    assert sum(r.doc_id == 100 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    for _, doc, ids in want:
        at = 0
        for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += packing.padded(at, 1024) - at
    assert total < 4 * 2 * 1024  # a few open windows of each task


def test_sequences_round_trip(docs):
    plain = Tokenizer.from_file(PATH)
    rows = packing.pack_ids(docs, PATH).collect()
    back = {}
    ids, positions, cuts = packing.id_matrix(rows, 1024, packing.id_width(PATH))
    for i, r in enumerate(rows):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.cu_seqlens[:-1] == r.position_resets
        assert cuts[i].tolist() == r.cu_seqlens and all(positions[i, x] == 0 for x in r.position_resets)
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(doc, []).append((start, ids[i, a:b].tolist()))
    for r in docs.collect():
        if r.doc_id not in (100, None):
            assert [x for _, part in sorted(back[r.doc_id]) for x in part] == [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]


def test_very_long_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["alpha ", "be\n", "gamma, ", "δ", "12 "]) for _ in range(800_000))  # some 3 MB
    want = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    got = sorted(packing.pack_pieces(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), PATH).where("doc_id = 1").collect(), key=lambda r: r.start)
    assert [r.start for r in got] == list(range(0, len(want), 1024)) and sum(r.length for r in got) == len(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) for r in got)


def test_shards(spark, docs, tmp_path):
    made = packing.pack_ids(docs, PATH)
    packing.write_ids(made, f"{tmp_path}/ids")
    read = spark.read.parquet(f"{tmp_path}/ids")
    assert read.columns == made.columns and read.count() == made.count()
    assert all(zlib.crc32(np.frombuffer(r.input_ids, f"<u{packing.id_width(PATH)}").astype("<u4").tobytes()) == r["ids_crc32"] for r in read.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_pieces(none, PATH).count() == 0 and packing.pack_ids(none, PATH).count() == 0
