"""Language-model scoring by prediction by partial matching (PPM) over bytes, pretrained on the corpus.

Model. A text is its words, each followed by a separator byte, then an end byte. A symbol's context is the ORDER bytes before
it, across words; separators stand before the first. The trie holds, for each context of 0 to ORDER bytes, the counts of
the bytes that follow it in the training texts. Coding tries the longest known context; a byte it hasn't seen escapes to the
context one byte shorter, whose counts leave out the symbols already ruled out (symbol exclusion). Escapes are estimated by
method D: each of d distinct symbols among n gives up half a count, so an escape has d / 2n. Below order 0 all bytes not yet
ruled out are equally likely.

Plan. A gram is a context and the byte after it, in one number whose highest bytes are the nearest ones, so that a context's grams
and those of all longer contexts that end in it are neighbours. Workers split documents into blocks and send each block's distinct
grams and words with their training counts, cut into SHARDS ranges; texts go along compressed, once. GROUP blocks are merged to a sum and to each
block's places in it, so no task reads a range of more than GROUP blocks. The sums are cut into narrower ranges, as many as
their size asks for, and each range's codes are computed from its grams and the counts of all byte triples (2^24 at most), which are broadcast. Codes
go back to the groups, to the blocks, and are added up over the texts. What is broadcast doesn't grow with the input, and no
task but that of a single three-byte context grows with it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import bucket_of, materialize, prepare

ORDER = 6
SEPARATOR, END = b" ", b"\n"
#: Bytes of text in a block, and in one piece of it that is in a worker's memory as numbers.
BLOCK_BYTES, PIECE_BYTES = 16_000_000, 1_000_000
#: Ranges of grams and of words in a block's rows; blocks of a group; grams of a narrower range, about.
SHARDS, GROUP, RANGE = 64, 512, 2_000_000
#: Grams that are held before they are merged.
HELD = 2_000_000
_U = np.uint64
#: An odd number and its inverse modulo 2^24: they spread the nearest three bytes evenly over the ranges.
_SPREAD, _GATHER = _U(0x9E3779), _U(pow(0x9E3779, -1, 1 << 24))
_24 = _U((1 << 24) - 1)
#: Bits of a gram, and of the number of a range.
_TOP = 8 * (ORDER + 1)
_BITS = SHARDS.bit_length() - 1


def _pack(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _open(x, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x.as_py() if isinstance(x, pa.Scalar) else x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their lowest bytes, then the next ones, and so on: compresses better."""
    return _pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)


def _unplanes(x, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_open(x, "u1").reshape(size, -1).T).view(kind).ravel()


def _rising(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Sorted numbers by their differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)).astype(kind))


def _risen(x, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(_unplanes(x, kind), dtype=kind)


def _joined(words: list[bytes]) -> bytes:
    """Words, none of which contains the end byte but the end token, which is nothing else."""
    return _pack(END.join(b"" if w == END else w for w in words))


def _words(x) -> list[bytes]:
    """The opposite of _joined, for one word at least."""
    return [w or END for w in _open(x).split(END)]


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def spelt(words: list[bytes]) -> bytes:
    """The coded bytes of tokens."""
    return SEPARATOR.join(words)


def _ranked(words: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words by their hash, then by themselves, which is the order that all lists of words have; the hashes; each given word's place."""
    coded = words.combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    found = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(zlib.crc32, found), _U, len(found))
    order = np.argsort(hashes, kind="stable")
    ties = hashes[order]
    for i in np.flatnonzero(ties[1:] == ties[:-1]).tolist():  # few words share a hash; neighbours change places until none is out of order
        while i >= 0 and ties[i] == ties[i + 1] and found[order[i]] > found[order[i + 1]]:
            order[i], order[i + 1] = order[i + 1], order[i]
            i -= 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [found[i] for i in order.tolist()], ties, place[coded.indices.to_numpy()]


def pieces(body: bytes, size: int) -> Iterator[tuple[bytes, bytes]]:
    """A body in parts of bounded size, each with the ORDER bytes before it."""
    past = SEPARATOR * ORDER
    for at in range(0, len(body), size):
        part = body[at : at + size]
        yield past, part
        past = (past + part[-ORDER:])[-ORDER:]


def grams(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The gram of each byte of the parts: three nearest bytes (spread), the farther ones, the byte itself."""
    buffer = np.frombuffer(b"".join(x for part in parts for x in part), np.uint8)
    key = buffer.astype(_U)
    for back in range(1, ORDER + 1):
        key[back:] |= buffer[:-back].astype(_U) << _U(8 * (ORDER + 1 - back))
    lengths = np.fromiter((len(b) for _, b in parts), np.int64, len(parts))
    start = np.cumsum(lengths + ORDER) - lengths
    coded = np.ones(len(key), bool)
    coded[(start[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    key = key[coded]
    low = _U(_TOP - 24)
    return (key & ((_U(1) << low) - _U(1))) | (((key >> low) * _SPREAD & _24) << low)


def _union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct numbers (np.unique hashes when asked for nothing else, which is slower than sorting)."""
    x = np.sort(np.concatenate(lists))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _summed_grams(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of several sorted lists, and their counts' sums."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    if len(parts) == 1 or not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Trie:
    """PPM over grams. `triples` are the numbers (nearest byte, the one before it, symbol) of the whole corpus, sorted, with their counts."""

    def __init__(self, triples: np.ndarray, counts: np.ndarray):
        self.triples, self.counts = triples, counts.astype(float)
        symbol, nearest, both = triples & 255, triples >> 16, triples >> 8
        self.pair = np.bincount(nearest << 8 | symbol, self.counts, 65536).reshape(256, 256)
        self.single = self.pair.sum(0)
        self.total2, self.distinct2 = np.bincount(both, self.counts, 65536), np.bincount(both, minlength=65536)
        #: What a context of two bytes rules out in that of one, and one byte in none.
        self.over2 = np.bincount(both, self.pair[nearest, symbol], 65536)
        self.over1 = ((self.pair > 0) * self.single).sum(1)

    def triple(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.triples, ids)
        at[at == len(self.triples)] = 0
        return np.where(self.triples[at] == ids, self.counts[at], 0.0) if len(self.triples) else np.zeros(len(ids))

    def codes(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context.

        `keys` are distinct and sorted, and hold all trained grams of the contexts of three bytes and more that
        they belong to; `counts` are 0 for those that training didn't see.
        """
        out, todo = np.zeros(len(keys)), np.ones(len(keys), bool)
        symbol = (keys & _U(255)).astype(np.int64)
        near = ((keys >> _U(_TOP - 24)) * _GATHER & _24).astype(np.int64)  # nearest byte, second, third
        out_total, out_distinct = np.zeros(len(keys)), np.zeros(len(keys))  # of the symbols ruled out
        for k in range(ORDER, -1, -1):
            ruled = None
            if k >= 3:
                entry = keys if k == ORDER else (keys >> _U(8 * (ORDER + 1 - k))) << _U(8) | (keys & _U(255))
                entry, where, at = np.unique(entry, return_index=True, return_inverse=True)
                count = np.bincount(at, counts, len(entry))
                context = entry >> _U(8)
                of = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
                if k > 3:  # the counts of this order's symbols in the next one
                    lower = (keys[where] >> _U(8 * (ORDER + 2 - k))) << _U(8) | (keys[where] & _U(255))
                    _, back = np.unique(lower, return_inverse=True)
                    there = np.bincount(back, count)[back]
                else:
                    there = self.triple((near[where] >> 8) << 8 | symbol[where])
                sums = lambda x: np.bincount(of, x)[of][at]
                total, distinct, mine, ruled = sums(count), sums(count > 0), count[at], sums(np.where(count > 0, there, 0.0))
            elif k == 2:
                both = near >> 8
                total, distinct, mine, ruled = self.total2[both], self.distinct2[both], self.triple(both << 8 | symbol), self.over2[both]
            elif k == 1:
                first = near >> 16
                total, distinct, mine, ruled = self.pair.sum(1)[first], (self.pair > 0).sum(1)[first], self.pair[first, symbol], self.over1[first]
            else:
                total, distinct, mine = self.single.sum(), (self.single > 0).sum(), self.single[symbol]
            left, new = total - out_total, distinct - out_distinct
            use = todo & (new > 0)
            seen = use & (mine > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(seen, out + np.log10((mine - 0.5) / left), np.where(use, out + np.log10(new / (2 * left)), out))
            todo &= ~seen
            out_total, out_distinct = ruled, distinct
        rest = 256 - (self.single > 0).sum()
        return np.where(todo, out - np.log10(max(rest, 1)), out)


def _runs(bodies: Iterable[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[bytes, bytes]]]]:
    """Bounded runs of pieces of bodies: the number of each piece's body, and the pieces."""
    now, of, total = [], [], 0
    for n, body in enumerate(bodies):
        for p in pieces(body, PIECE_BYTES):
            if now and total + len(p[1]) > PIECE_BYTES:
                yield np.array(of), now
                now, of, total = [], [], 0
            now.append(p)
            of.append(n)
            total += len(p[1])
    if now:
        yield np.array(of), now


def _bodies(x) -> list[bytes]:
    """A text row's bodies: each ends in the end byte, which is nowhere else."""
    return _open(x).splitlines(keepends=True)


BLOCKS = "kind string, block long, shard int, part int, n long, a binary, b binary"
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_TYPES)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _cuts(numbers: np.ndarray, width: int, first: int, count: int, bits: int) -> np.ndarray:
    """Where each of `count` ranges, from the first one on, of sorted numbers of `width` bits begins; ranges go by the highest bits."""
    return np.searchsorted(numbers, (_U(first) + np.arange(count + 1, dtype=_U)) << _U(width - bits))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, held out, text) to blocks: 'text', 'word' and 'gram' rows."""
    block, number = TaskContext.get().partitionId() << 24, 0
    held, size = 0, 0  # bytes in the block and in its last piece
    bodies, ids, fresh = [], [], []
    words, trained, found = [], [], []  # of the block: its tokens, whether they are learned from, its grams

    def piece() -> pa.Table:
        """The texts since the last piece: their grams are counted, the row holds what is scored later."""
        for out_of_training in (False, True):
            for _, now in _runs([body for body, (_, h) in zip(bodies, ids) if h == out_of_training]):
                keys, counts = np.unique(grams(now), return_counts=True)
                found.append((keys, counts * 0 if out_of_training else counts))
            if sum(len(k) for k, _ in found) > HELD:
                found[:] = [_summed_grams(found)]
        words.append(pa.array([w for part in fresh for w in part], pa.binary()))
        trained.append(np.repeat([not h for _, h in ids], [len(part) for part in fresh]))
        whose = np.array([(i is None, h) for i, h in ids], "u1").tobytes() + np.array([i or 0 for i, _ in ids], "<i8").tobytes()
        return _table([("text", block + number, None, None, len(ids), _pack(b"".join(bodies), 3), whose)])

    def asked() -> pa.Table:
        ranked, hashes, place = _ranked(pa.chunked_array(words))
        known = np.bincount(place, np.concatenate(trained), len(ranked))
        keys, counts = _summed_grams(found)
        of_words, of_keys, rows = _cuts(hashes, 32, 0, SHARDS, _BITS), _cuts(keys, _TOP, 0, SHARDS, _BITS), []
        for s in range(SHARDS):
            if own := ranked[of_words[s] : of_words[s + 1]]:
                rows.append(("word", block + number, s, None, len(own), _joined(own), _planes(known[of_words[s] : of_words[s + 1]].astype("<u8"))))
            if len(own := keys[of_keys[s] : of_keys[s + 1]]):
                rows.append(("gram", block + number, s, None, len(own), _rising(own), _planes(counts[of_keys[s] : of_keys[s + 1]].astype("<u8"))))
        return _table(rows)

    for batch in batches:
        for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            fresh.append(tokens(text.as_py()))
            bodies.append(spelt(fresh[-1]))
            ids.append((i, h))
            size, held = size + len(bodies[-1]), held + len(bodies[-1])
            if size >= PIECE_BYTES or held >= BLOCK_BYTES:
                yield from piece().to_batches()
                bodies, ids, fresh, size = [], [], [], 0
            if held >= BLOCK_BYTES:
                yield from asked().to_batches()
                words, trained, found, held, number = [], [], [], 0, number + 1
    if ids:
        yield from piece().to_batches()
    if held:
        yield from asked().to_batches()


def _merge(key, table):
    """A group's rows of one kind and range: a 'sum' row of all grams or words with counts, and each block's places in it."""
    kind, group, shard = (x.as_py() for x in key)
    if kind == "gram":
        lists = [_risen(x) for x in table["a"]]
        whole, counts = _summed_grams([(x, _unplanes(c, "<u8")) for x, c in zip(lists, table["b"])])
        packed, places = _rising(whole), (np.searchsorted(whole, x) for x in lists)
    else:
        lists, sums = [_words(x) for x in table["a"]], Counter()
        for words, c in zip(lists, table["b"]):
            for w, n in zip(words, _unplanes(c, "<u8").tolist()):
                sums[w] += n
        whole = sorted(sums, key=lambda w: (zlib.crc32(w), w))
        place = {w: i for i, w in enumerate(whole)}
        counts, packed = np.array([sums[w] for w in whole], "<u8"), _joined(whole)
        places = (np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in lists)
    rows = [(f"{kind} sum", group, shard, 0, len(whole), packed, _planes(counts.astype("<u8")))]
    for block, x in zip(table["block"].to_pylist(), places):
        rows.append((f"{kind} map", block, shard, group, len(x), _rising(x, "<u4"), None))
    return _table(rows)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (nearest byte, the one before it, symbol), summed over a row of grams."""
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            keys = _risen(a)
            near = (keys >> _U(_TOP - 24)) * _GATHER & _24
            ids, at = np.unique((near >> _U(8) << _U(8) | (keys & _U(255))).astype(np.int64), return_inverse=True)
            n = np.bincount(at, _unplanes(b, "<u8"), len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0], pa.int64()), pa.array(n[n > 0])], names=["triple", "n"])


def _cut(bits: int):
    """'sum' rows in 2^bits narrower ranges each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = _words(r["a"]) if r["kind"] == "word sum" else None
                numbers, width = (np.fromiter(map(zlib.crc32, words), _U, len(words)), 32) if words else (_risen(r["a"]), _TOP)
                cuts, counts = _cuts(numbers, width, r["shard"] << bits, 1 << bits, _BITS + bits), _unplanes(r["b"], "<u8")
                for p in range(1 << bits):
                    a, b = cuts[p], cuts[p + 1]
                    if a < b:
                        yield from _table([(r["kind"], r["block"], r["shard"], p, b - a, _joined(words[a:b]) if words else _rising(numbers[a:b]), _planes(counts[a:b]))]).to_batches()

    return run


def _coded(shared):
    """All groups' sums of one range to 'gram code' rows: the codes of each group's grams, in their order."""

    def run(key, table):
        lists = [_risen(x) for x in table["a"]]
        keys, counts = _summed_grams([(x, _unplanes(c, "<u8")) for x, c in zip(lists, table["b"])])
        codes = Trie(*shared.value).codes(keys, counts.astype(float)).astype("<f4")
        return _table([("gram code", g, key[0].as_py(), key[1].as_py(), len(x), _planes(codes[np.searchsorted(keys, x)]), None) for g, x in zip(table["block"].to_pylist(), lists)])

    return run


def _counted(key, table):
    """All groups' sums of a range of words to 'word code' rows of the whole corpus's counts, and a 'known' row."""
    sums: Counter = Counter()
    lists = [_words(x) for x in table["a"]]
    for words, c in zip(lists, table["b"]):
        for w, n in zip(words, _unplanes(c, "<u8").tolist()):
            sums[w] += n
    rows = [("word code", g, key[0].as_py(), key[1].as_py(), len(x), _planes(np.array([sums[w] for w in x], "<u8")), None) for g, x in zip(table["block"].to_pylist(), lists)]
    return _table([*rows, ("known", None, None, None, sum(n > 0 for n in sums.values()), None, None), ("trained", None, None, None, sum(sums.values()), None, None)])


def _told(key, table):
    """A group's 'code' and 'map' rows of one range to 'tell' rows: each block's codes or counts, in the order it asked."""
    kind, _, shard = (x.as_py() for x in key)
    number = "<f4" if kind == "gram" else "<u8"
    rows = table.to_pylist()
    codes = np.concatenate([_unplanes(r["a"], number) for r in sorted((r for r in rows if r["kind"].endswith("code")), key=lambda r: r["part"])])
    return _table([(f"{kind} tell", r["block"], shard, None, r["n"], _planes(codes[_risen(r["a"], "<u4")]), None) for r in rows if r["kind"].endswith("map")])


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(train_tokens: int, known: int):
    """A block's 'text' and 'tell' rows to scores."""

    def run(key, table):
        tells = table.filter(pa.array([k != "text" for k in table["kind"].to_pylist()])).sort_by("shard")
        told = {kind: [x for k, x in zip(tells["kind"].to_pylist(), tells["a"]) if k == f"{kind} tell"] for kind in ("gram", "word")}
        codes = np.concatenate([_unplanes(x, "<f4") for x in told["gram"]])
        counts = np.concatenate([_unplanes(x, "<u8") for x in told["word"]]).astype(float)
        texts = table.filter(pa.array([k == "text" for k in table["kind"].to_pylist()]))
        runs, words = [], []
        for x in texts["a"]:  # the block's grams and words again, in the order that the tells have
            bodies = _bodies(x)
            words.append(pa.array([w for body in bodies for w in (*body.split(), END)], pa.binary()))
            runs += [_union([grams(now)]) for _, now in _runs(bodies)]
            if sum(map(len, runs)) > HELD:
                runs = [_union(runs)]
        keys = _union(runs)
        place = _ranked(pa.chunked_array(words))[2]
        base, seen = np.log10((counts + 1) / (train_tokens + known + 1))[place], (counts > 0)[place]
        out, at = {name.split()[0]: [] for name in SCORES.split(", ")}, 0
        for x, whose, own in zip(texts["a"], texts["b"].to_pylist(), words):
            bodies, n = _bodies(x), len(whose) // 10
            marks, ids = np.frombuffer(whose[: 2 * n], "u1").reshape(n, 2), np.frombuffer(whose[2 * n :], "<i8")
            score = np.zeros(n)
            for of, now in _runs(bodies):
                found, back = np.unique(grams(now), return_inverse=True)
                each = codes[np.searchsorted(keys, found)].astype(float)[back]
                lengths = np.fromiter((len(b) for _, b in now), np.int64, len(now))
                np.add.at(score, of, np.add.reduceat(each, np.cumsum(lengths) - lengths))
            tokens_of = np.fromiter((body.count(SEPARATOR) + 1 for body in bodies), np.int64, n)
            first = np.cumsum(tokens_of) - tokens_of
            out["id"] += [None if none else i for none, i in zip(marks[:, 0].tolist(), ids.tolist())]
            out["held_out"] += (marks[:, 1] > 0).tolist()
            out["n_tokens"] += tokens_of.tolist()
            out["n_known"] += np.add.reduceat(seen[at : at + len(own)].astype(np.int64), first).tolist()
            out["train_tokens"] += [train_tokens] * n
            out["base_score"] += np.add.reduceat(base[at : at + len(own)], first).tolist()
            out["score"] += score.tolist()
            at += len(own)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], names=list(out))

    return run


def ppm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from the rows for which `held_out` isn't true (default: crc32 of the id as text, modulo 7, is 2);
    null ids are learned from. Null texts count as empty and have the end token only. base_score is the unigram
    model with add-one smoothing over the same tokens. Repeated rows are counted and scored each. Without any training row
    all bytes are equally likely. An empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    held = F.coalesce(bucket_of(id_col, 7) == 2 if held_out is None else held_out, F.lit(False))
    blocks = materialize(docs.select(F.col(id_col).cast("long"), held, F.col(text_col)).mapInArrow(_split, BLOCKS), "blocks")
    asks = blocks.where("kind <> 'text'")
    groups = 1 + (asks.agg(F.count_distinct("block")).first()[0] or 0) // GROUP
    dealt = asks.withColumn("dealt", F.pmod(F.xxhash64("block"), F.lit(groups)))
    merged = materialize(dealt.groupBy("kind", "dealt", "shard").applyInArrow(_merge, BLOCKS), "merged")
    sums = {k: merged.where(F.col("kind") == f"{k} sum") for k in ("gram", "word")}
    sizes = dict(merged.groupBy("kind").agg(F.sum("n")).collect())  # four rows

    def ranges(kind: str) -> DataFrame:
        bits = max(0, int(sizes.get(f"{kind} sum", 0)) // (SHARDS * RANGE)).bit_length()
        return sums[kind].mapInArrow(_cut(bits), BLOCKS).groupBy("shard", "part")

    words = materialize(ranges("word").applyInArrow(_counted, BLOCKS), "words")
    totals = dict(words.groupBy("kind").agg(F.sum("n")).collect())  # three rows
    triples = sums["gram"].select("a", "b").mapInArrow(_triples, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    low = triples.toArrow().sort_by("triple")  # at most 2^24 rows
    shared = spark.sparkContext.broadcast((low["triple"].to_numpy(), low["n"].to_numpy()))
    codes = ranges("gram").applyInArrow(_coded(shared), BLOCKS).unionByName(words.where("kind = 'word code'"))
    is_map = F.col("kind").endswith("map")
    routed = codes.unionByName(merged.where(is_map)).select("*", F.substring_index("kind", " ", 1).alias("what"), F.when(is_map, F.col("part")).otherwise(F.col("block")).alias("dealt"))
    tells = routed.groupBy("what", "dealt", "shard").applyInArrow(_told, BLOCKS)
    scored = blocks.where("kind = 'text'").unionByName(tells).groupBy("block").applyInArrow(_scored(totals.get("trained", 0), totals.get("known", 0)), SCORES)
    return scored.withColumnRenamed("id", id_col)
