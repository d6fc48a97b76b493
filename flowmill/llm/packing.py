"""Best-fit-decreasing packing of token ids: a segment tree over remaining capacity finds the tightest open window.

Documents longer than a window are first cut into full windows; their rests and the short documents are packed
block by block inside the scan, so neither texts nor ids are shuffled. A block holds at most BLOCK_TOKENS ids,
thousands of windows, which bounds a worker's memory; its few open windows are all the padding there is.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import prepare
from flowmill.llm.tokens import encoder

BLOCK_TOKENS = 4_000_000
#: Pieces that a block may hold, for tables of very short texts.
BLOCK_PIECES = 100_000
#: Bits of a sequence id that count sequences within a task; the task's number stands above.
SEQUENCE_BITS = 36

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES = (
    "sequence_id long, n_tokens long, padded_length long, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, "
    "position_resets array<int>, input_ids binary, ids_crc32 long"
)


class Capacities:
    """Open windows by remaining capacity. A node of the tree counts the windows at the leaves below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        node = remaining + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity of at least `need`, and that capacity."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.windows[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length; windows are numbered from 0. Equal lengths go in the order given."""
    tree, out, n = Capacities(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, n = (n, capacity), n + 1
        window, remaining = found
        out[i] = window, capacity - remaining
        if remaining > lengths[i]:
            tree.add(remaining - lengths[i], window)
    return out


def padded(length: int, capacity: int) -> int:
    """Rows of the id matrix are padded to the capacity, except at a power of two."""
    return length if length & (length - 1) == 0 else capacity


def _blocks(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[list[tuple[int | None, int, array, int]]]:
    """Pieces (id, start, ids, tokens of the document) of a bounded number of documents."""
    encode = encoder(path).encode
    block, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "")
            ids.append(end_id)
            for start in range(0, len(ids), capacity):
                block.append((doc, start, ids[start : start + capacity], len(ids)))
                held += len(block[-1][2])
                if held >= BLOCK_TOKENS or len(block) >= BLOCK_PIECES:
                    yield block
                    block, held = [], 0
    if block:
        yield block


def _raw(ids: array, width: int = 4) -> bytes:
    return np.asarray(ids, f"<u{width}").tobytes()


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[tuple[list, list[tuple[int, int]], int]]:
    """Blocks of pieces with their (window, offset), and the id of the block's first window."""
    base = TaskContext.get().partitionId() << SEQUENCE_BITS
    for block in _blocks(batches, path, capacity, end_id):
        places = best_fit_decreasing([len(x[2]) for x in block], capacity)
        yield block, places, base
        base += 1 + max(w for w, _ in places)


def pack_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece (see PIECES): where each id of each row's text, and the end id after it, lies.

    Null and empty texts have the end id only. Overlong texts are cut into full windows and a rest; each id lies
    in exactly one piece. Repeated rows are packed each; null ids stay null. Other columns are ignored. An empty
    table gives no piece. Sequence ids are unique; offsets in a sequence leave no gap.
    """
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches):
        for block, places, base in _packed(batches, path, capacity, end_id):
            rows = [(doc, start, len(ids), zlib.crc32(_raw(ids)), total, base + w, at) for (doc, start, ids, total), (w, at) in zip(block, places)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def pack_ids(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence (see SEQUENCES): the packed ids and the boundaries a trainer needs.

    input_ids has the ids without padding as little-endian unsigned numbers of `id_width` bytes; cu_seqlens starts
    at 0 and ends at n_tokens; position_resets lists the offsets at which positions begin again at 0. Edge cases
    are those of pack_pieces, and the pieces of a cut document keep their start in doc_starts, so texts round-trip.
    """
    width = id_width(path)
    types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.binary(), pa.int64()]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(SEQUENCES.split(", "), types)])

    def run(batches):
        for block, places, base in _packed(batches, path, capacity, end_id):
            windows: dict[int, list] = {}
            for piece, (w, at) in zip(block, places):
                windows.setdefault(w, []).append((at, piece))
            rows = []
            for w, found in windows.items():
                found.sort(key=lambda x: x[0])
                ids = array("I")
                for _, piece in found:
                    ids.extend(piece[2])
                resets = [at for at, _ in found]
                rows.append((base + w, len(ids), padded(len(ids), capacity), [p[0] for _, p in found], [p[1] for _, p in found], [*resets, len(ids)], resets, _raw(ids, width), zlib.crc32(_raw(ids))))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SEQUENCES)


def id_width(path: str) -> int:
    """Bytes of one packed id: two where the vocabulary fits."""
    return 2 if encoder(path).size <= 1 << 16 else 4


def write_ids(sequences: DataFrame, out: str) -> None:
    """Write packed sequences as Parquet shards: each row is one matrix row with its boundaries."""
    sequences.write.mode("overwrite").parquet(out)


def id_matrix(rows: list, capacity: int, width: int, pad_id: int = 0):
    """(ids, positions, cu_seqlens) of some packed rows as numpy arrays, rows padded to the longest padded length."""
    longest = max([r["padded_length"] for r in rows], default=0)
    ids = np.full((len(rows), longest), pad_id, np.uint32)
    positions = np.zeros((len(rows), longest), np.int32)
    for i, r in enumerate(rows):
        ids[i, : r["n_tokens"]] = np.frombuffer(r["input_ids"], f"<u{width}")
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            positions[i, a:b] = np.arange(b - a)
    return ids, positions, [np.asarray(r["cu_seqlens"], np.int32) for r in rows]
