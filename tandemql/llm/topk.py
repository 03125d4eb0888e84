"""Exact top-k by inner product: MaxScore over shards of candidates, then a merge of the shards' lists.

A vector's components are its terms. A shard keeps, for each term, the postings (the candidates' values
in one row) and the term's least and greatest value, which bound what the term can add to a query's
score. For a query, terms are ordered by that bound. The terms with the smallest bounds, which together
can't lift a candidate over the query's k-th best score so far, are non-essential: only the essential
postings are traversed, and the others are probed for the candidates that are still competitive, in
steps, each of which leaves fewer. A candidate that can only tie is kept, as its id may be smaller.

Candidates are packed to shards of SHARD_ROWS vectors and queries to blocks of QUERY_BLOCK, a row of binaries each, which are
written to the shared folder. Every shard meets every block: that is what an exact search of a stated set of queries
against all rows takes, and it is done by tasks that each read some shards and some blocks; neither
goes through the driver. A task carries each query's best k from shard to shard, so that later shards start with a
threshold, and reports them once; a query's rows of all tasks are merged. A small set of blocks is
broadcast by Spark, by its own size bound.

Scores are integers. A shard in which a query's score may reach 2**53, beyond which doubles aren't exact, is scored by
whole numbers without bounds; a score beyond 64 bits is an error.

Defined cases: vectors that are null or hold null or non-finite components take no part; a missing
component counts as 0; ids that are null take no part; equal scores rank by the smaller id, and repeated
rows of one id (other than the query's own) are candidates each; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemql.llm.common import materialise, pick

QUERY_BLOCK, SHARD_ROWS = 2048, 4096
#: Candidates whose full scores set a query's first threshold.
SEEDS = 64
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector can't take part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(wide, lambda x: F.floor(F.lit(scale) * x)))


Best = tuple[np.ndarray, np.ndarray]  # ids and scores, best first


def _scored(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray) -> Best:
    """Everything but the query's own, by whole numbers of any size."""
    scores = vectors.astype(object) @ query.astype(object)
    keep = ids != query_id
    if any(not -(1 << 63) <= x < 1 << 63 for x in scores[keep]):
        raise OverflowError(f"a score of query {query_id} is beyond 64 bits")
    return ids[keep], scores[keep].astype(np.int64)


def _merged(one: Best, two: Best, k: int) -> Best:
    ids, scores = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[Best]) -> None:
    """Bring each query's best ``k`` so far up to date with the shard's candidates, whose ``ids`` ascend."""
    whole, postings = vectors, np.ascontiguousarray(vectors.T, dtype=float)
    low, high = postings.min(axis=1), postings.max(axis=1)
    widest = np.maximum(np.abs(low), np.abs(high))
    for n, (q, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        if float(np.abs(query.astype(float)) @ widest) >= 2.0**53:
            best[n] = _merged(best[n], _scored(ids, whole, q, query), k)
            continue
        query = query.astype(float)
        most, least = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
        terms = np.argsort(-(most - least), kind="stable")
        weights = query[terms]
        rest = np.concatenate([np.cumsum(most[terms][::-1])[::-1], [0.0]])  # what the terms from i on can add
        begin, end = np.searchsorted(ids, (q, q + 1))
        own = end - begin
        theta = float(best[n][1][k - 1]) if len(best[n][1]) == k else -np.inf
        if not np.isfinite(theta) and len(ids) - own > k:
            some = np.setdiff1d(np.arange(min(SEEDS, len(ids))), np.arange(begin, end), assume_unique=True)
            if len(some) >= k:
                theta = np.partition(query @ postings[:, some], -k)[-k]
        # Essential: as many leading terms as it takes until the rest alone can't reach the threshold.
        essential = max(1, int(np.searchsorted(-rest, -theta, side="right"))) if np.isfinite(theta) else len(terms)
        essential = min(essential, len(terms))
        alive = np.arange(len(ids))
        score = weights[:essential] @ postings[terms[:essential]]
        done = essential
        while True:
            stay = score + rest[done] >= theta
            alive, score = alive[stay], score[stay]
            if done == len(terms) or not len(alive):
                break
            more = terms[done : done + 8]
            score = score + query[more] @ postings[np.ix_(more, alive)]
            done += len(more)
            if len(alive) > k + own and done < len(terms):
                theta = max(theta, np.partition(score, -k - own)[-k - own] + least[terms[done:]].sum())
        keep = (alive < begin) | (alive >= end)
        best[n] = _merged(best[n], (ids[alive[keep]], score[keep].astype(np.int64)), k)


PACKED = "ids binary, dims int, vectors binary"


def _packing(rows: int):
    """Vectors, ascending by id within a row, as little-endian longs; a missing component is 0."""

    def packed(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(1, max(map(len, vectors)))
        wide = np.zeros((len(ids), dims), dtype="<i8")
        for i, v in enumerate(vectors):
            wide[i, : len(v)] = v
        own = np.array(ids, dtype="<i8")
        order = np.argsort(own, kind="stable")
        cols = [pa.array([own[order].tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([wide[order].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["ids", "dims", "vectors"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for part in parts:
            flat = part.column(1)
            values, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            for i, vec_id in enumerate(part.column(0).to_pylist()):
                ids.append(vec_id)
                vectors.append(values[at[i] : at[i + 1]])
                if len(ids) == rows:
                    yield packed(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield packed(ids, vectors)

    return run


def _unpacked(ids: bytes, dims: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(vectors, dtype="<i8").reshape(-1, dims)


def _widened(vectors: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1]))) if vectors.shape[1] < dims else vectors


def _searching(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, tuple[np.ndarray, np.ndarray, list[Best]]] = {}
        for part in parts:
            for i in range(part.num_rows):
                ids, dims, vectors, q_ids, q_dims, q_vectors = (part.column(c)[i].as_py() for c in range(6))
                if q_ids not in blocks:
                    none = np.zeros(0, dtype=np.int64)
                    own, asked = _unpacked(q_ids, q_dims, q_vectors)
                    blocks[q_ids] = own, asked, [(none, none)] * len(own)
                own, asked, best = blocks[q_ids]
                candidates, rows = _unpacked(ids, dims, vectors)
                wide = max(dims, q_dims)
                search_shard(candidates, _widened(rows, wide), own, _widened(asked, wide), k, best)
        for own, _, best in blocks.values():
            sizes = [len(ids) for ids, _ in best]
            cols = [np.repeat(own, sizes), np.concatenate([ids for ids, _ in best]), np.concatenate([scores for _, scores in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Both tables (vec_id long, terms array<long>); to query_id, rank, vec_id, score. A query is no candidate of its own."""
    usable = candidates.where("vec_id IS NOT NULL AND terms IS NOT NULL").select("vec_id", "terms")
    asked = queries.where("vec_id IS NOT NULL AND terms IS NOT NULL").select("vec_id", "terms").dropDuplicates(["vec_id"])
    shards = materialise(usable.mapInArrow(_packing(SHARD_ROWS), PACKED), "shards")
    blocks = materialise(asked.mapInArrow(_packing(QUERY_BLOCK), PACKED), "blocks").toDF("q_ids", "q_dims", "q_vectors")
    found = shards.crossJoin(blocks).mapInArrow(_searching(k), FOUND)  # a row per shard and block, of thousands of vectors each
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_embeddings(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Queries: rows whose id ``every`` divides; candidates: all rows."""
    rows = pick(table, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("vector"), scale).alias("terms"))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
