"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, bands, exact verification.

Signatures. The weight of a shingle (its count) is discretised into units. Each unit has a Poisson process of rate 1
over time, derived from a hash of (shingle, unit); a point falls into one of M components, whose earliest point is the
signature. Processes are hierarchical: the units [0,1), [1,2), [2,4), [4,8), ... are joined to nodes whose first point
comes at the node's joint rate and is split down to its unit, so most of a heavy shingle's units are never visited.
The chance that two components agree is the weighted Jaccard similarity. Only points before a time horizon are drawn;
if a component stays empty the horizon doubles, which never changes the points before it.

Candidates. BANDS keys of ROWS components each. Texts with the same words in the same order are one text first. In a bucket of few texts
each pair is a candidate; in a larger one each text is paired with one leader, so that a group of near copies of any
size gives as many pairs as members. Larger buckets that the links leave in several parts get another round: texts outside the
largest part are paired with a few of its texts, drawn anew, and with each other as in a bucket of their own. The texts of buckets that are
still open are then joined exactly: a link of two
texts in different parts shares one of the few rarest shingles of both (prefix filter), at places that leave enough for
the overlap (positional filter), so a passage that many texts share makes no pairs unless it is long enough for a link.

Verification. Each candidate pair's shingle multisets are compared in full. Classes are the components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import few_or_shuffled, free, join_groups, materialize, numbered, prepare, scratch

SHINGLE = 5
#: A pair is a link if 100 * overlap >= SIMILAR * union of the multisets.
SIMILAR = 80
#: At similarity 0.8 a pair misses all bands with a chance of 3e-6.
ROWS, BANDS = 5, 32
M = ROWS * BANDS
#: Buckets of at most so many texts give all pairs (28); larger ones one pair a text.
SMALL = 8
#: Rounds with new leaders, at most, and leaders of a bucket in each.
ROUNDS, LEADERS = 1, 6
#: Counters of how common a shingle is among texts of open buckets; shared ones only make the exact join slower.
COUNTERS = 1 << 20
#: Links that one task may unite: 16 bytes each, some 100 MB as a dictionary.
FEW_LINKS = 500_000
#: Shingles that are drawn for at once.
CHUNK = 200_000

_U = np.uint64
_GOLD, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space: bytes.split() cuts at exactly those six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and their counts. A text of 1 to 4 words has one shingle of all of them."""
    n = len(words)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    width = min(n, SHINGLE)
    out = _mix(h[: n - width + 1] + _U(width))
    for i in range(1, width):
        out = _mix(out ^ h[i : n - width + 1 + i])
    return np.unique(out, return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of M 32-bit tags for each (shingles, counts); a text without a shingle has zeros."""
    out = np.zeros((len(docs), M), np.uint32)
    total = np.array([c.sum() for _, c in docs], float)
    todo, factor = np.flatnonzero(total > 0), np.log(M) + 3.0
    while len(todo):
        missed = []
        start = 0
        while start < len(todo):  # bounded chunks of whole documents
            end, held = start, 0
            while end < len(todo) and (end == start or held + len(docs[todo[end]][0]) <= CHUNK):
                held += len(docs[todo[end]][0])
                end += 1
            own = todo[start:end]
            tags, full = _draw([docs[i] for i in own], M * factor / total[own])
            out[own[full]] = tags[full]
            missed.append(own[~full])
            start = end
        todo, factor = np.concatenate(missed), factor * 2
    return out


def _draw(docs: list[tuple[np.ndarray, np.ndarray]], horizon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tags of the earliest points of each component before the horizon; whether all components have one."""
    doc = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    h, c = np.concatenate([h for h, _ in docs]), np.concatenate([c for _, c in docs])
    work, lo, size = [], 0, 1
    pick = np.arange(len(h))
    while len(pick):  # the roots [0,1), [1,2), [2,4), ... that the weights reach
        work.append(_first(doc[pick], h[pick], c[pick], np.full(len(pick), lo), np.full(len(pick), size), np.zeros(len(pick)), horizon))
        lo, size = (1, 1) if lo == 0 else (lo + size, 2 * size)
        pick = pick[c[pick] > lo]
    now = [np.concatenate(x) for x in zip(*work)]
    slots, times, tags = [], [], []
    while len(now[0]):
        doc, h, c, lo, size, x, s = now
        leaf = size == 1
        d, t, state = doc[leaf], x[leaf], s[leaf]
        slots.append(d * M + (state % _U(M)).astype(np.int64))
        times.append(t)
        tags.append((_mix(state) >> _U(32)).astype(np.uint32))
        state = _mix(state)
        t = t - np.log(_unit(state))
        stay = t <= horizon[d]
        follow = [[v[leaf][stay] for v in (doc, h, c, lo, size)] + [t[stay], state[stay]]]
        if not leaf.all():
            doc, h, c, lo, size, x, s = (v[~leaf] for v in now)
            half = size // 2
            right = (s & _U(1)).astype(bool)
            for side in (False, True):  # the child that the coin picks has the parent's point, the other one a later point
                at = np.where(side, lo + half, lo)
                use = at < c
                begin = [v[use] for v in (doc, h, c, at, half, x)]
                has = (right == side)[use]
                got = _first(*[v[has] for v in begin], horizon, keep=True)
                late = _first(*[v[~has] for v in begin], horizon)
                follow += [got, late]
        now = [np.concatenate(v) for v in zip(*follow)]
    slot, time, tag = np.concatenate(slots), np.concatenate(times), np.concatenate(tags)
    best = np.full(len(docs) * M, np.inf)
    np.minimum.at(best, slot, time)
    out = np.zeros(len(docs) * M, np.uint32)
    wins = time == best[slot]
    out[slot[wins]] = tag[wins]
    return out.reshape(-1, M), np.isfinite(best).reshape(-1, M).all(1)


def _first(doc, h, c, lo, size, x, horizon, keep: bool = False):
    """Nodes with their first point: after x at the node's rate, or x itself; only those before the horizon."""
    s = _mix(h ^ _mix(lo.astype(_U) * _U(64) + np.log2(size).astype(_U)))
    if not keep:
        x = x - np.log(_unit(s)) / size
        s = _mix(s)
    ok = x <= horizon[doc]
    return [v[ok] for v in (doc, h, c, lo, size, x, s)]


def band_keys(tags: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each signature, the band's number included."""
    parts = tags.reshape(len(tags), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(_mix(np.arange(BANDS, dtype=_U)), parts.shape[:2])
    for i in range(ROWS):
        key = _mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def overlap_at_least(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int = SIMILAR) -> bool:
    """Whether the multisets' weighted Jaccard similarity is at least `percent` hundredths."""
    na, nb = int(a[1].sum()), int(b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return 100 * both >= percent * (na + nb - both)


SKETCH = "rid long, id long, same string, n long, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            same, bags = [], []
            for text in part.column(2):
                words = words_of(text.as_py())
                same.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                bags.append(shingles(words))
            keys = band_keys(signatures(bags)).tolist()
            n = [int(c.sum()) for _, c in bags]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(same), pa.array(n, pa.int64()), pa.array([k if x else [] for k, x in zip(keys, n)], pa.list_(pa.int64()))],
                names=[x.split()[0] for x in SKETCH.split(", ")],
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, bag = None, None
    for batch in batches:
        keep = []
        for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
            if a != last or bag is None:
                last, bag = a, shingles(words_of(x.as_py()))
            if overlap_at_least(bag, shingles(words_of(y.as_py()))):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def _unit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, part, units): a shingle that occurs c times is c units, so that overlaps of multisets are those of sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part, units = batch.slice(at, 250), []
            for text in part.column(2):
                h, c = shingles(words_of(text.as_py()))
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                units.append(_mix(np.repeat(h, c) ^ _mix(nth.astype(_U))).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(units, pa.list_(pa.int64()))], names=["rid", "part", "units"])


def _prefixes(common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, rid, n, most, part) of each text's rarest units, in one order for all texts.

    A pair whose first common unit is this one, the i-th of n, overlaps in n - i units at most, which is enough for
    a link with a text of `most` units at most. A link needs a text of SIMILAR hundredths of n at least.
    """
    for batch in batches:
        out = [[] for _ in range(5)]
        for rid, part, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            units = units.values.to_numpy(zero_copy_only=False)
            n = len(units)
            most = (100 * n - (100 + SIMILAR) * np.arange(n)) // SIMILAR
            most = most[100 * most >= SIMILAR * n]
            units = units[np.lexsort((units, common[units & (COUNTERS - 1)]))[: len(most)]]
            for x, y in zip(out, (units, np.full(len(most), rid), np.full(len(most), n), most, np.full(len(most), part))):
                x.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["unit", "rid", "n", "most", "part"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of one task, by union-find with the least node as root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = [(x, r) for x in root if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["node", "root"])


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(node, root) for the nodes of links (a, b) but the roots themselves; a root is its component's least node.

    A counted, bounded number of links is united in one task. More take alternating large-star and small-star steps until
    nothing changes: each is a partial aggregation and a join, so a node with many links is no bottleneck. Nothing is
    collected to the driver either way.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    with scratch() as keep:
        edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
        if edges.count() <= (FEW_LINKS if few is None else few):
            return keep(materialize(edges.coalesce(1).mapInArrow(_united, "node long, root long"), "roots"))
        seen = None
        while True:
            edges = materialize(star(star(edges, True), False), "star")
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                return keep(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
            seen = now


def _all_pairs(few: DataFrame) -> DataFrame:
    """Each pair of the rows (key, rid, n) of a key; only for keys of at most SMALL rows."""
    groups = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rid", "n"))).alias("g"))
    pairs = F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x as x, y as y))))")
    return groups.select(F.explode(pairs).alias("p")).select(F.col("p.x.rid").alias("a"), F.col("p.y.rid").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"))


def _fit(pairs: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes allow a link: the smaller multiset bounds the overlap."""
    fits = 100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")
    return pairs.where(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bucket_pairs(buckets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of rows (key, rid, n): all in small buckets, a star in larger ones; and the larger buckets' rows."""
    lead = F.min_by(F.struct("rid", "n"), F.xxhash64(F.lit(seed), "rid"))
    groups = materialize(buckets.groupBy("key").agg(F.count("*").alias("k"), lead.alias("lead")).where("k > 1"), "groups")
    members = materialize(join_groups(buckets, groups, "key"), "buckets")
    large = members.where(F.col("k") > SMALL)
    stars = large.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
    return _all_pairs(members.where(F.col("k") <= SMALL)).unionByName(stars), large.select("key", "rid", "n")


def _parts(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, rid, n, part) of texts (rid, n, keys): a text meets its root once, not once for each bucket."""
    named = large.join(roots, large["rid"] == roots["node"], "left")
    return named.select(F.explode("keys").alias("key"), "rid", "n", F.coalesce("root", "rid").alias("part"))


def _open_pairs(large: DataFrame, roots: DataFrame, first_seed: int) -> DataFrame:
    """Candidate pairs of larger buckets that links left in several parts: what stands apart with LEADERS texts of the largest part."""
    parts = _parts(large, roots)
    leads = F.array(*[F.min_by(F.struct("rid", "n"), F.xxhash64(F.lit(first_seed + i), "rid")) for i in range(LEADERS)])
    sizes = parts.groupBy("key", "part").agg(F.count("*").alias("c"), leads.alias("leads"))
    most = sizes.groupBy("key").agg(F.max_by(F.struct("part", "leads"), F.struct("c", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    top = materialize(most.select("key", "top"), "top")
    apart = materialize(join_groups(parts, top, "key").where(F.col("part") != F.col("top.part")).select("key", "rid", "n", "top.leads"), "apart")
    ahead = apart.select("rid", "n", F.explode(F.array_distinct("leads")).alias("lead"))
    ahead = ahead.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
    return ahead.unionByName(_bucket_pairs(apart.select("key", "rid", "n"), first_seed)[0])


def _left_pairs(large: DataFrame, roots: DataFrame, placed: DataFrame) -> DataFrame:
    """All pairs that may be links between different parts of the larger buckets: none that is one is left out.

    For each unit the pairs are made from the fewer of two sets of rows, either of which each pair has a member in: those
    outside the unit's largest part, and those that a text of the same size or a larger one may match.
    """
    parts = _parts(large, roots)
    open_keys = materialize(parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key"), "open-keys")
    texts = few_or_shuffled(join_groups(parts, open_keys, "key").select("rid", "part").distinct(), "open")
    bodies = placed.select("rid", "body").join(texts, "rid").select("rid", "part", "body")
    units = materialize(bodies.mapInArrow(_unit_hashes, "rid long, part long, units array<long>"), "units")
    slots = units.select(F.explode("units").alias("u")).groupBy(F.col("u").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("slot")).agg(F.count("*").alias("c"))
    counted = slots.where("c > 1").toArrow()
    common = np.zeros(COUNTERS, np.int64)
    common[counted.column("slot").to_numpy()] = counted.column("c").to_numpy()
    shared = placed.sparkSession.sparkContext.broadcast(common)
    rows = materialize(units.mapInArrow(lambda batches: _prefixes(shared.value, batches), "unit long, rid long, n long, most long, part long"), "prefixes")
    rows = rows.withColumn("up", F.col("most") >= F.col("n"))
    sizes = rows.groupBy("unit", "part").agg(F.count("*").alias("c"), F.count_if("up").alias("ups"))
    sizes = sizes.groupBy("unit").agg(
        F.max_by("part", F.struct("c", "part")).alias("top"), (F.sum("c") - F.max("c")).alias("apart"), F.sum("ups").alias("ups"), F.count("*").alias("parts")
    )
    shared_units = materialize(sizes.where("parts > 1 and ups > 0").select("unit", "top", (F.col("ups") <= F.col("apart")).alias("by_up")), "shared")
    rows = materialize(join_groups(rows, shared_units, "unit"), "matched")
    x, y = rows.where(F.when(F.col("by_up"), F.col("up")).otherwise(F.col("part") != F.col("top"))).alias("x"), rows.alias("y")
    meet = (F.col("x.unit") == F.col("y.unit")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    return x.join(y, meet).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def _tested(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Pairs that may be links and haven't been compared, written."""
    pairs = _fit(pairs)
    return materialize(pairs if before is None else pairs.join(before, ["a", "b"], "left_anti"), "pairs")


def _linked(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are links, written; the texts that were moved for it are deleted again."""
    with scratch() as keep:
        return keep(materialize(_verify(placed, pairs), "verified"))


def _classes(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, root, n_links) of all texts (rid, id, body), and (root, class_id, class_size, first) of classes of several rows; both written."""
    sketch = materialize(placed.mapInArrow(_sketched, SKETCH), "sketch")
    texts = sketch.groupBy("same").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    again = materialize(texts.where("copies > 1").select("same", "rep"), "copies")
    # Rows whose text occurs once are their own representative and need no join back.
    spare = materialize(join_groups(sketch.select("rid", "same"), again, "same").where("rid <> rep").select("rid", "rep"), "spare")
    reps = sketch.join(spare.select("rid"), "rid", "left_anti").where("n > 0")
    with scratch() as keep:
        found, large = _bucket_pairs(reps.select(F.explode("bands").alias("key"), "rid", "n"), 0)
        tested = keep(_tested(found))
        large = keep(materialize(large.groupBy("rid", "n").agg(F.collect_list("key").alias("keys")), "large"))
    links = _linked(placed, tested)
    roots = components(links)
    if not large.isEmpty():

        def extend(pairs: Callable[[], DataFrame]) -> bool:
            """Compare more pairs; whether any was a link."""
            nonlocal tested, links, roots
            with scratch() as keep:
                new = keep(_tested(pairs(), tested))
            more = _linked(placed, new)
            tested, links = tested.unionByName(new), links.unionByName(more)
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            return not more.isEmpty()

        for seed in range(1, ROUNDS + 1):
            if not extend(lambda: _open_pairs(large, roots, seed)):
                break
        extend(lambda: _left_pairs(large, roots, placed))
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = sketch.select("rid", "id").join(spare, "rid", "left").withColumn("rep", F.coalesce("rep", "rid"))
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = materialize(named.join(degree, "rep", "left").select("rid", "id", "root", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "named")
    classes = named.groupBy("root").agg(
        F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
    )
    return named, materialize(classes.where("class_size > 1"), "classes")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """One row per input row: id, class_id (least id of the class), class_size, n_links, kept, rid.

    rid is the column rid_col, which must be stored with the rows; without it the rows are written with one first.

    n_links counts the verified links of the row's text to different texts. One row of each class stays: the one with
    the least id, the first of repeated rows. Null text counts as empty; texts without a word are copies of each
    other. Null ids come last in a class. An empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")]
    with scratch() as keep:
        placed = docs.select(F.col(rid_col).alias("rid"), *columns) if rid_col else numbered(docs.select(*columns)).select("rid", "id", "body")
        named, classes = _classes(placed)
        keep(named)
        keep(classes)
    joined = join_groups(named, classes, "root", how="left")
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "n_links",
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"), "rid",
    )


def _verify(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are links. Only texts of candidate pairs are moved."""
    ids = few_or_shuffled(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
    bodies = materialize(placed.select("rid", "body").join(ids, "rid", "left_semi"), "bodies")
    first = pairs.join(bodies.select(F.col("rid").alias("a"), F.col("body").alias("x")), "a")
    both = first.join(bodies.select(F.col("rid").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, with one row of each class of near copies."""
    rid = free(docs, "__rid")
    marked = numbered(docs, rid)
    with scratch() as keep:
        gone = near_groups(marked, id_col, text_col, rid).where(~F.col("kept")).select(F.col("rid").alias(rid))
        gone = keep(materialize(gone, "gone"))
    return marked.join(few_or_shuffled(gone), rid, "left_anti").drop(rid)
