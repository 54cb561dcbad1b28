"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document's weighted set holds its five-word shingles; a weight is the number of occurrences times
``1 + IDF_STRENGTH * idf``. The idf is ``log(N / df)`` over ``log(FREQUENT)``, cut to 0..1: a shingle that fewer than one in
``FREQUENT`` documents hold has idf 1, one in every document 0. So it depends on shares of the corpus alone, and only
the document frequencies of frequent shingles matter. These are exact: hashed counters over all documents find the
buckets that may hold a frequent shingle, and a second pass counts the shingles of those buckets one by one. At most
``FREQUENT`` times the mean number of shingles of a document can be frequent, so the table has a bound that does not
grow with the corpus. The idf is damped so that a large group of near copies does not weigh down the very shingles
that it shares. Weights are multiples of 1/1024, so that sums are exact in double precision in any order, and a pair is
judged alike wherever it is compared.

``BANDS`` bands of ``ROWS`` samples each propose pairs, which are verified by the exact weighted Jaccard similarity of
the whole texts' sets. Equal texts are one node from the start. Within a bucket, pairs are not emitted: two rounds
compare members to one pivot each. A bucket whose members are then connected is done; of the others, small ones
compare the pairs that are still unconnected, and large ones are cut into blocks of about ``BLOCK`` members, of which
each pair of blocks is compared by one matrix product; blocks of the bucket's largest component are not compared
to each other. So no proposed link between classes is lost, and there is no cap. A bucket of n members that are not
connected moves each of their sets n / ``BLOCK`` times; that is quadratic, but only such buckets pay for it. Members of a
bucket are salted wherever it is joined, so a hot bucket is many tasks. Classes are the connected components of the
verified links.

Documents without a word (null, empty, blank) are never grouped. Texts of fewer words than a shingle have
one shingle of all of them. Words are lower-cased. Repeated rows share their class; a class is named by its
smallest doc_id, null only if it has no other. An empty table gives no rows. Other columns of the input are ignored
by ``near_duplicates`` and kept as they are, whatever their names, by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, lean, numbered, slices, small_batches, written
from tidemark.llm.text import Words, mix, shingle_keys, unique_counts

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 9, 3
FREQUENT = 128
TABLE_BITS = 15
IDF_STRENGTH = 0.2
SALTS = 64  # at most 64: the salts that a bucket has are bits of a long
SMALL, BLOCK = 16, 512
WORD = r"[^\x20\x09-\x0D]"
_LOW48 = np.uint64((1 << 48) - 1)
_MOST = 65535  # occurrences in one element of a packed set


class Weights:
    """The weight of one occurrence: of the frequent shingles by table, of all others ``rare``."""

    def __init__(self, shingles: np.ndarray, weights: Weights, rare: float):
        self.shingles, self.weights, self.rare = shingles, weights, rare

    def __reduce__(self):
        return Weights, (self.shingles, self.weights, self.rare)

    @cached_property
    def maybe(self) -> np.ndarray:
        held = np.zeros(1 << 20, bool)
        held[(self.shingles >> np.uint64(28)).astype(np.intp)] = True
        return held

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.rare)
        if len(self.shingles):
            at = np.flatnonzero(self.maybe[(shingles >> np.uint64(28)).astype(np.intp)])
            i = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
            same = self.shingles[i] == shingles[at]
            out[at[same]] = self.weights[i[same]]
        return out


def weight_of(frequency: np.ndarray, documents: int) -> np.ndarray:
    """The weight of one occurrence by document frequency, a multiple of 1/1024."""
    idf = np.clip(np.log(max(1, documents) / np.maximum(1, frequency)) / np.log(FREQUENT), 0, 1)
    return np.round(1024 * (1 + IDF_STRENGTH * idf)) / 1024


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - bits)).astype(np.int64)


def idf_weights(docs: DataFrame) -> Weights:
    """Weights from exact document frequencies over all of ``docs``."""
    texts = docs.select("text")
    documents, chars = texts.agg(F.count_if(F.col("text").rlike(WORD)), F.coalesce(F.avg(F.when(F.col("text").rlike(WORD), F.length("text"))), F.lit(0.0))).first()
    rare = float(weight_of(np.zeros(1), max(documents, FREQUENT))[0])
    # Counters enough for the mean load to be well below the count that makes a shingle frequent.
    bits = min(24, max(12, math.ceil(math.log2(4 * FREQUENT * (1 + chars / 6)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                keys, _ = unique_counts(shingle_keys(Words(piece.column("text")), SHINGLE))
                counts += np.bincount(_bucket(keys & _LOW48, bits), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    # Either table has at most FREQUENT times the mean number of shingles of a document rows on the driver.
    often = F.sum("n").alias("n"), F.col("n") * FREQUENT >= documents
    with small_batches(docs.sparkSession):
        buckets = texts.mapInArrow(lean(count), "at long, n long").groupBy("at").agg(often[0]).where(often[1]).toArrow()
    chosen = np.zeros(1 << bits, bool)
    chosen[buckets.column("at").to_numpy()] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times)], names=["at", "n"])

        for batch in batches:
            for piece in slices(batch, "text"):
                keys, _ = unique_counts(shingle_keys(Words(piece.column("text")), SHINGLE))
                keys &= _LOW48
                held.append(keys[chosen[_bucket(keys, bits)]])
                size += len(held[-1])
                if size > 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    if not chosen.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), rare)
    with small_batches(docs.sparkSession):
        counted = texts.mapInArrow(lean(exact), "at long, n long").groupBy("at").agg(often[0]).where(often[1]).toArrow().sort_by("at")
    return Weights(counted.column("at").to_numpy().astype(np.uint64), weight_of(counted.column("n").to_numpy(), documents), rare)


class Sampler:
    """Band keys of weighted sets by improved consistent weighted sampling, the random draws from tables by hash."""

    def __init__(self, weights: Weights, bands: int = BANDS, rows: int = ROWS, seed: int = 6):
        rng = np.random.default_rng(seed)
        k, m = bands * rows, 1 << TABLE_BITS
        self.weights, self.bands, self.rows = weights, bands, rows
        self.r = rng.gamma(2.0, 1.0, (k, m)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, (k, m))).astype(np.float32)
        self.beta = rng.random((k, m), np.float32)
        self.factor = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have a word, and their band keys (rows, bands)."""
        keys, times = unique_counts(shingle_keys(Words(texts), SHINGLE))
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros((0, self.bands), np.int64)
        doc, shingle = keys >> np.uint64(48), keys & _LOW48
        log_w = np.log(times * self.weights(shingle)).astype(np.float32)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        lengths = np.diff(np.append(starts, len(doc)))
        number = np.repeat(np.arange(len(starts)), lengths)
        bands = np.zeros((len(starts), self.bands), np.uint64)
        for k, factor in enumerate(self.factor):
            at = ((shingle * factor) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(log_w / r + beta)
            a = self.log_c[k][at] - r * (t - beta) - r
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            first = least[np.concatenate(([True], number[least[1:]] != number[least[:-1]]))]
            sample = mix(shingle[first] * np.uint64(0x9E3779B97F4A7C15) + t[first].astype(np.int64).astype(np.uint64))
            band = k // self.rows
            bands[:, band] = mix(bands[:, band] * np.uint64(0xD6E8FEB86659FD93) + sample + np.uint64(band + 1))
        return doc[starts].astype(np.int64), bands.view(np.int64)


def set_bytes(texts: pa.Array) -> list[bytes]:
    """The weighted set of each text: ascending uint64 ``hash48 << 16 | occurrences``. A shingle of more than
    ``_MOST`` occurrences has several elements, which add up."""
    keys, times = unique_counts(shingle_keys(Words(texts), SHINGLE))
    parts = -(-times // _MOST)
    if len(times) and parts.max() > 1:
        first = np.repeat(np.cumsum(parts) - parts, parts) == np.arange(parts.sum())
        keys, times = np.repeat(keys, parts), np.where(first, np.repeat(times - (parts - 1) * _MOST, parts), _MOST)
    packed = ((keys & _LOW48) << np.uint64(16)) | times.astype(np.uint64)
    ends = np.searchsorted(keys >> np.uint64(48), np.arange(len(texts) + 1).astype(np.uint64))
    return [packed[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _load(sets: list[bytes], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle, occurrences and weight of one occurrence for all shingles."""
    data = np.frombuffer(b"".join(sets), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets])
    shingle, times = data >> np.uint64(16), (data & np.uint64(_MOST)).astype(np.int64)
    if (times == _MOST).any():
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))))
        row, shingle, times = row[first], shingle[first], np.add.reduceat(times, first)
    return row, shingle, times, weights(shingle)


def similarities(left: list[bytes], right: list[bytes], weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of two lists of under 65536 sets, one by one; 0 where either is empty."""
    n = len(left)
    (ra, sa, ta, w), (rb, sb, tb, wb) = _load(left, weights), _load(right, weights)
    total = np.bincount(ra, weights=ta * w, minlength=n) + np.bincount(rb, weights=tb * wb, minlength=n)
    if not len(ra) or not len(rb):
        return np.zeros(n)
    a, b = (ra.astype(np.uint64) << np.uint64(48)) | sa, (rb.astype(np.uint64) << np.uint64(48)) | sb
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    shared = np.bincount(ra[same], weights=np.minimum(ta[same], tb[at[same]]) * w[same], minlength=n)
    return shared / np.maximum(total - shared, 1e-12)


def _features(sets: list[bytes], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of every occurrence: the j-th of a shingle is a feature of its own, so that sums over
    common features are sums of minima."""
    row, shingle, times, w = _load(sets, weights)
    again = np.repeat(np.arange(len(row)), times)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
    return row[again], mix(shingle[again] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), w[again]


def block_similarities(left: list[bytes], right: list[bytes], weights: Weights, dense_from: int = 4096, width: int = 2048, most: int = 1 << 20) -> np.ndarray:
    """The matrix of similarities between two blocks of sets."""
    (ra, fa, wa), (rb, fb, wb) = _features(left, weights), _features(right, weights)
    na, nb = len(left), len(right)
    total_a, total_b = np.bincount(ra, weights=wa, minlength=na), np.bincount(rb, weights=wb, minlength=nb)
    common = np.intersect1d(fa, fb)
    shared = np.zeros((na, nb))
    if len(common):
        sides = []
        for r, f, w in ((ra, fa, wa), (rb, fb, wb)):
            at = np.minimum(np.searchsorted(common, f), len(common) - 1)
            held = common[at] == f
            order = np.argsort(at[held], kind="stable")
            sides.append((r[held][order], at[held][order], w[held][order]))
        (ra, ia, wa), (rb, ib, _) = sides
        ca, cb = np.bincount(ia, minlength=len(common)), np.bincount(ib, minlength=len(common))
        first_a, first_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
        dense = ca * cb >= dense_from
        column = np.cumsum(dense) - 1
        for low in range(0, int(dense.sum()), width):
            x, y = np.zeros((na, width)), np.zeros((nb, width))
            for matrix, r, i, v in ((x, ra, ia, wa), (y, rb, ib, None)):
                use = dense[i] & (column[i] >= low) & (column[i] < low + width)
                matrix[r[use], column[i[use]] - low] = 1 if v is None else v[use]
            shared += x @ y.T
        few = np.flatnonzero(~dense)
        products = np.cumsum((ca * cb)[few])
        at = 0
        while at < len(few):  # about ``most`` products at once
            end = max(at + 1, int(np.searchsorted(products, most + (products[at - 1] if at else 0), side="right")))
            f, at = few[at:end], end
            n = ca[f] * cb[f]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            f = np.repeat(f, n)
            a, b = first_a[f] + k // cb[f], first_b[f] + k % cb[f]
            shared += np.bincount(ra[a] * nb + rb[b], weights=wa[a], minlength=na * nb).reshape(na, nb)
    return shared / np.maximum(total_a[:, None] + total_b - shared, 1e-12)


def forest(linked: np.ndarray) -> np.ndarray:
    """The least connected index of each, from a symmetric matrix of links."""
    labels = np.arange(len(linked))
    while True:
        least = np.minimum(labels, np.where(linked, labels, len(labels)).min(1, initial=len(labels)))
        least = least[least]
        if np.array_equal(least, labels):
            return labels
        labels = least


def node_of(text: str | Column) -> Column:
    """Equal texts are one node."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, node and bands per row; node and bands are null without a word."""
    rows = docs.select("doc_id", "text", node_of("text").alias("node"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights)
        for batch in batches:
            for piece in slices(batch, "text"):
                at, keys = sampler(piece.column("text"))
                there = np.zeros(piece.num_rows, bool)
                there[at] = True
                offsets = np.concatenate(([0], np.cumsum(there * keys.shape[1]))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                node = pa.array([x if y else None for x, y in zip(piece.column("node").to_pylist(), there, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), node, bands], names=["doc_id", "node", "bands"])

    return rows.mapInArrow(lean(sign), "doc_id long, node binary, bands array<long>")


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def _dealt(rows: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """The aggregates of each ``key``, a row for each salt that its rows have: joined by key and salt, a hot key is as many
    tasks. The aggregates are combined before the shuffle."""
    whole = rows.groupBy(key).agg(*aggs, F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    return whole.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1))).drop("salts")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): node and comp, its component's least node; linked nodes only.

    Alternating large and small stars: only minima are gathered per node, never its neighbours.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v", _salt("v"))
        least = _dealt(both, "u", F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().select("u", "v", _salt("v"))
        least = _dealt(large, "u", F.min("v").alias("m"))
        tips = least.select("u", F.col("m").alias("v")).distinct()
        small = large.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tips).where("u <> v").distinct()
        last, edges, before = edges, written(small, "cc"), now
        now = state(edges)
        discard(last)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches ``threshold``; b, which may be in many pairs, is salted."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "sa", "sb", max_bytes=1 << 21):
                kept = similarities(piece.column("sa").to_pylist(), piece.column("sb").to_pylist(), weights) >= threshold
                yield piece.select(["a", "b"]).filter(pa.array(kept))

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    left = salted.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return left.join(right, ["b", "salt"]).select("a", "b", "sa", "sb").mapInArrow(lean(verify), "a binary, b binary")


def _open(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members (band, salt, node, comp) of the buckets that hold more than one component."""
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return rows.join(_dealt(rows, "band", F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band", "salt"), ["band", "salt"])


def _block_links(rows: DataFrame, sets: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links between members of different components in large buckets: rows are (band, salt, node, comp).

    The members of a bucket's largest component (side 0) and the others (side 1) are dealt into blocks by hash.
    Compared are all pairs of blocks of side 1, and each block of side 1 with each of side 0.
    """
    per = rows.groupBy("band", "comp").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("has"))
    stats = per.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.bit_or("has").alias("has"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    stats = stats.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("has", s) == 1)))
    stats = stats.select("band", "salt", F.col("top.comp").alias("top"), blocks(F.col("top.n")).alias("n0"), blocks(F.col("all") - F.col("top.n")).alias("n1"))
    rows = rows.join(stats, ["band", "salt"]).withColumn("side", (F.col("comp") != F.col("top")).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "band"), F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n0")).cast("long")).cast("int"))
    # A pair of blocks is (i of side 1, j): j counts the blocks of side 1 from i on, then those of side 0.
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    mine = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda k: pair(F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    with_top = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda k: pair(F.col("own"), F.col("n1") + k))
    as_top = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda k: pair(k, F.col("n1") + F.col("own")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("side") == 1, F.concat(mine, with_top)).otherwise(as_top)))
    rows = rows.select("band", "p.i", "p.j", "node", "comp", F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("n1") + F.col("own")).alias("own"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, node, held = table.column("own").to_numpy(), np.array(table.column("node").to_pylist(), object), table.column("set").to_pylist()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out: list[tuple] = []
        if len(a) and len(b):
            linked = block_similarities([held[x] for x in a], [held[x] for x in b], weights) >= threshold
            matrix = np.zeros((len(own),) * 2, bool)
            matrix[np.ix_(a, b)] = linked
            matrix |= matrix.T
            out = [(node[x], node[y]) for x, y in enumerate(forest(matrix)) if x != y]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return rows.join(sets, "node").groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary")


def classes(docs: DataFrame, signed: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """Per node: class_id, class_size, class_node (the node that holds the row named by class_id) and n_links, the
    number of other texts to which a link was verified; what lies within one component by then is not verified."""
    nodes = written(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "dedup-nodes")
    bands = signed.where(F.col("node").isNotNull()).select(F.explode("bands").alias("band"), _salt("node"), "node").distinct()
    shared = _dealt(bands, "band", F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band", "salt")
    members = written(bands.join(shared, ["band", "salt"]), "dedup-buckets")
    none = F.lit(np.iinfo(np.int64).min)
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.coalesce("first", none).alias("first"))
    texts = docs.select("text", node_of("text").alias("node"), F.coalesce("doc_id", none).alias("first")).join(wanted, ["node", "first"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(set_bytes(piece.column("text")), pa.binary())], names=["node", "set"])

    sets = written(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(lean(pack), "node binary, set binary"), "dedup-sets")
    proven: list[DataFrame] = []
    comps: DataFrame | None = None
    tested: DataFrame | None = None

    def join_links(found: DataFrame) -> None:
        nonlocal comps
        links = found if comps is None else comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found)
        last, edges = comps, components(links)
        comps = written(edges, "dedup-comps")
        discard(last)
        proven.append(found)

    for by in (F.struct("node"), F.struct(F.xxhash64("node"), "node")):
        rows = _open(members, comps)
        pivots = _dealt(rows, "band", F.min_by(F.struct("node", "comp"), by).alias("p")).select("band", "salt", F.col("p.node").alias("other"), F.col("p.comp").alias("other_comp"))
        pairs = rows.join(pivots, ["band", "salt"]).where("comp <> other_comp").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        last, tested = tested, written(pairs, "dedup-pairs")
        discard(last)
        join_links(written(_verified(tested, sets, weights, threshold), "dedup-links"))
    rest = written(_open(members, comps), "dedup-open")
    few = _dealt(rest, "band", F.count("*").alias("members"))
    small = rest.join(few.where(F.col("members") <= SMALL).select("band", "salt"), ["band", "salt"])
    other = small.select("band", F.col("node").alias("b"), F.col("comp").alias("other_comp"))
    pairs = written(small.withColumnRenamed("node", "a").join(other, "band").where("comp < other_comp").select("a", "b").distinct(), "dedup-pairs")
    large = rest.join(few.where(F.col("members") > SMALL).select("band", "salt"), ["band", "salt"])
    found = _verified(pairs, sets, weights, threshold).unionByName(_block_links(large, sets, weights, threshold))
    join_links(written(found, "dedup-links"))
    discard(members, sets, tested, rest, pairs)
    ends = reduce(DataFrame.unionByName, proven).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    n_links = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rows = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(n_links, "node", "left")
    order = F.struct(F.col("first").isNull(), "first", "node")
    named = rows.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"), F.min_by("node", order).alias("class_node"))
    return rows.join(named, "comp").select("node", "class_id", "class_size", "class_node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size (rows in the class) and n_links (other texts to which a link was verified, at
    least one if the class holds another text) for every row of ``docs``."""
    weights = idf_weights(docs)
    signed = written(signatures(docs, weights), "dedup-signatures")
    known = classes(docs, signed, weights, threshold)
    columns = ("doc_id", "class_id", "class_size", "n_links")
    rows = signed.where(F.col("node").isNotNull()).select("doc_id", "node").join(known, "node").select(*columns)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return rows.unionByName(signed.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), zero.alias("n_links")))


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of its class_id, and every document without a word, with their columns."""
    weights = idf_weights(docs)
    signed = written(signatures(docs, weights), "dedup-signatures")
    known = classes(docs, signed, weights, threshold)
    wordy = signed.where(F.col("node").isNotNull())
    none = F.lit(np.iinfo(np.int64).min)
    times = wordy.groupBy("node", F.coalesce("doc_id", none).alias("id")).agg(F.count("*").alias("times"))
    reps = known.where(F.col("node") == F.col("class_node")).select("node", F.coalesce("class_id", none).alias("id")).join(times, ["node", "id"])
    columns, back = numbered(docs)
    rows = docs.select(*columns, node_of("text").alias("node"), F.coalesce("doc_id", none).alias("id")).join(reps, ["node", "id"])
    once = rows.where("times = 1").select(*back)
    again = rows.where("times > 1").dropDuplicates(["node", "id"]).select(*back)
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(WORD))
    return reduce(DataFrame.unionByName, (once, again, blank))
