"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one entry from each of ``CODEBOOKS`` full-dimensional codebooks, learned on residuals and
refitted jointly by least squares; encoding keeps the best few partial sums (beam search). The index holds
codes, the norm of the reconstruction and the original vector. A search sums lookup-table entries per code,
takes the best of every ``BLOCK_ROWS`` rows by that and reranks them exactly in double precision on the original
vectors. What part of a block is reranked is measured when the index is built: the smallest part that finds
``TARGET`` of the true neighbours among sampled vectors which the codebooks weren't fitted on, the whole block if none does.

The index is fitted on at most about ``sample_rows`` vectors and holds every one. Queries are handled in blocks of
bounded size, each against all rows; a task keeps only its best ``k`` per query, and has up to ``TASK_ROWS`` rows, so that
few of these are shuffled. Vectors that are null or zero, hold null or non-finite components, or differ in length
from most take no part, as rows without a vec_id. Components stay floats or doubles as they are given. Rows that share
a query's vec_id are its own; the query is then the least of their vectors. Repeated rows are candidates one by one. Ties
go to the smaller vec_id. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.common import lean, written

CODEBOOKS, ENTRIES = 8, 256
QUERY_BLOCK = 8192
BLOCK_ROWS, TASK_ROWS = 4096, 1 << 20
TARGET = 0.98
METRICS = ("ip", "l2")


class Index(NamedTuple):
    """Codebooks, the part of a block that is reranked, by measure, and the table: vec_id, codes, norm, embedding."""

    books: np.ndarray
    parts: dict[str, float]
    table: DataFrame


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    kind = vectors.schema["embedding"].dataType.elementType
    whole = F.col("embedding") if isinstance(kind, FloatType) else F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", whole.alias("embedding")).where(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (sizes[0] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (np.sum(centers * centers, 1) - 2 * x @ centers.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers, dtype=np.float64)
        np.add.at(sums, at, x)
        centers[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        centers[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return centers


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (rows, codebooks) by beam search over residuals."""
    n, m = len(x), len(books)
    codes = np.zeros((n, 1, m), np.uint8)
    residual = x[:, None, :]
    for j, book in enumerate(books):
        cost = (residual * residual).sum(-1)[..., None] - 2 * residual @ book.T + (book * book).sum(1)
        width = min(beam, cost.shape[1] * ENTRIES)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        parent, entry = best // ENTRIES, best % ENTRIES
        codes = np.take_along_axis(codes, parent[..., None], 1)
        codes[:, :, j] = entry
        residual = np.take_along_axis(residual, parent[..., None], 1) - book[entry]
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, j]] for j, book in enumerate(books))


def train(x: np.ndarray, beam: int = 4, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Codebooks (codebooks, entries, dimensions) from a sample of vectors."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    residual, books = x, []
    for _ in range(CODEBOOKS):
        book = _kmeans(residual, ENTRIES, rounds, rng)
        books.append(book)
        residual = residual - book[_nearest(residual, book)]
    out = np.array(books)
    codes = np.concatenate([encode(x[i : i + 1024], out, beam) for i in range(0, len(x), 1024)]).astype(np.int64)
    # Joint refit: the entries that together reconstruct the sample best, held near the learned ones.
    at = codes + np.arange(CODEBOOKS) * ENTRIES
    gram = np.zeros((CODEBOOKS * ENTRIES,) * 2)
    for i in range(CODEBOOKS):
        for j in range(CODEBOOKS):
            np.add.at(gram, (at[:, i], at[:, j]), 1.0)
    target = np.zeros((CODEBOOKS * ENTRIES, x.shape[1]))
    left = x - decode(codes, out)
    for i in range(CODEBOOKS):
        np.add.at(target, at[:, i], left)
    change = np.linalg.solve(gram + np.eye(len(gram)), target)
    return (out.reshape(-1, x.shape[1]) + change).reshape(out.shape).astype(np.float32)


def encode_all(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    x = x.astype(np.float32)
    return np.concatenate([encode(x[i : i + 512], books, beam) for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, len(books)), np.uint8)


def exact(queries: np.ndarray, candidates: np.ndarray, metric: str) -> np.ndarray:
    """The measure in double precision, row by row in one order of summation, so that equal vectors tie."""
    a, b = queries.astype(np.float64), candidates.astype(np.float64)
    return (a * b).sum(-1) if metric == "ip" else -((a - b) ** 2).sum(-1)


def part_needed(x: np.ndarray, books: np.ndarray, beam: int, metric: str, k: int = 20, queries: int = 256, target: float = TARGET) -> float:
    """The part of ``x`` that has to be reranked, taken by lookup tables, to find ``target`` of each query's ``k`` nearest."""
    codes = encode_all(x, books, beam).astype(np.intp)
    near = decode(codes, books)
    k, n = min(k, len(x) - 1), min(queries, len(x))
    if k < 1:
        return 1.0
    ranks = []
    for q in range(n):
        true, rough = exact(x[q], x, metric), exact(x[q], near, metric)
        true[q] = rough[q] = -np.inf
        place = np.empty(len(x))
        place[np.argsort(-rough, kind="stable")] = np.arange(len(x))
        ranks.append(place[np.argsort(-true, kind="stable")[:k]])
    return float(min(1.0, (np.quantile(np.concatenate(ranks), target, method="higher") + 1) / len(x)))


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    total = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    picked = rows.where(draw < F.lit(min(1 << 30, -(-(1 << 30) * n // max(1, total))))).select(draw.alias("draw"), "vec_id", "embedding")
    picked = picked.orderBy("draw", "vec_id", "embedding").limit(2 * n).toArrow()
    return _matrix(picked.column("embedding").combine_chunks())


def build(vectors: DataFrame, sample_rows: int = 8192, beam: int = 4, seed: int = 9) -> Index:
    """The index of every usable vector; one in five of the sample measures it and is not fitted on."""
    rows = usable(vectors)
    kind = rows.schema["embedding"].dataType.simpleString()
    x = _sample(rows, sample_rows, seed)
    if not len(x):
        return Index(np.zeros((CODEBOOKS, ENTRIES, 1), np.float32), dict.fromkeys(METRICS, 1.0), written(rows.selectExpr("vec_id", "cast(null as binary) codes", "cast(0 as double) norm", "embedding").limit(0), "ann-index"))
    held = np.arange(len(x)) % 5 == 4
    books = train(x[~held], beam, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            codes = encode_all(x, books, beam)
            norm = np.sqrt((decode(codes, books).astype(np.float64) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), batch.column("embedding")], names=["vec_id", "codes", "norm", "embedding"])

    table = written(rows.mapInArrow(lean(run), f"vec_id long, codes binary, norm double, embedding {kind}"), "ann-index")
    return Index(books, {m: part_needed(x[held], books, beam, m) for m in METRICS}, table)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows, ``rows`` at a time, however they come."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, part: float, least: int, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.einsum("qd,med->qme", queries.astype(np.float32), books)
        best_score = np.full((len(ids), k), -np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        for block in _blocks(batches, BLOCK_ROWS):
            vec = block.column("vec_id").to_numpy()
            order = np.argsort(vec, kind="stable")  # by vec_id, so that of equal approximations the smaller ids are taken
            vec, x = vec[order], _matrix(block.column("embedding").combine_chunks())[order]
            codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))[order].T.astype(np.intp)
            half = 0.5 * block.column("norm").to_numpy()[order].astype(np.float32) ** 2
            shortlist = max(least, k + 1, int(np.ceil(part * len(vec))))
            for q, table in enumerate(tables):
                at = np.arange(len(vec))
                if len(vec) > shortlist:
                    approx = table[0][codes[0]]
                    for m in range(1, len(books)):
                        approx += table[m][codes[m]]
                    if metric == "l2":
                        approx -= half
                    lowest = np.partition(approx, len(vec) - shortlist)[len(vec) - shortlist]
                    above = np.flatnonzero(approx > lowest)
                    at = np.concatenate((above, np.flatnonzero(approx == lowest)[: shortlist - len(above)]))
                at = at[vec[at] != ids[q]]
                score = np.concatenate((best_score[q], exact(queries[q], x[at], metric)))
                near = np.concatenate((best_id[q], vec[at]))
                top = np.lexsort((near, -score))[:k]
                best_score[q], best_id[q] = score[top], near[top]
        q, r = np.nonzero(best_score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, r]), pa.array(best_score[q, r])], names=["query_id", "vec_id", "score"])

    return run


def search(index: Index, is_query: Column, k: int = 20, part: float | None = None, least: int = 200, metric: str = "ip") -> DataFrame:
    """The ``k`` nearest of every query row: query_id, rank, vec_id, score (higher is nearer; l2: minus the squared distance).

    Of every block of rows the best ``part`` by lookup tables, the measured one if none is given, and at least ``least``
    rows, are reranked exactly.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    table, part = index.table, index.parts[metric] if part is None else part
    rows, asked = table.count(), table.where(is_query)
    # As many tasks as there are cores, and more only beyond TASK_ROWS a task: each of them shuffles k rows a query.
    tasks = max(1, -(-rows // TASK_ROWS), min(table.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS)))
    blocks = max(1, -(-2 * asked.count() // QUERY_BLOCK))
    dealt = table.repartition(tasks, "vec_id")
    out = None
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow().sort_by("vec_id")
        found = dealt.mapInArrow(lean(_search(held.column("vec_id").to_numpy(), _matrix(held.column("embedding").combine_chunks()), index.books, k, part, least, metric)), "query_id long, vec_id long, score double")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        if blocks > 1:  # one block at a time: its tables are the only ones held
            found = written(found, "ann-block")
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "rank", "vec_id", "score")
