"""Exact top-k inner products by columnar branch and bound.

Vectors are turned into integers, ``floor(256 * x)``. Queries and candidates are dealt into a grid of cells by a hash of their
ids, so that each cell holds about ``CELL_QUERIES`` queries against ``CELL_CANDIDATES`` candidates; a query goes to every
candidate group and a candidate to every query group. In a cell the candidates lie in vertical layout, a contiguous row for
each dimension. For a query the partial product grows one block of dimensions at a time; what the rest can add is at most
the product of the two remaining norms (its remaining mass), so candidates whose upper bound is below the k-th best lower
bound are compacted away before the next block. Dimensions are taken in order of the query's mass, the heaviest first. Ties
with the bound survive, so the k best by (score, smaller id) of a cell are exact, and so are the best over all cells.

Vectors that are null, or hold null, NaN or infinite components (also after scaling), take no part; vectors of different lengths
never meet. A vector without components scores 0. The bounds leave room for the rounding of float64 sums; where the product of two
norms passes 2**52, the candidates that survive are scored again in whole numbers. A score beyond a long counts as the nearest long,
in the ranking too. Repeated rows count as different candidates with the same id; a query leaves out all rows of its own id, and equal
queries are answered once. Two vectors with one id are two queries. Rows without id take no part. Empty tables give empty results.

Exact search looks at every pair of a query and a candidate at least once, so its work grows as queries times candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
QUERY_EVERY = 50
SCALE = 256
BLOCK = 16
CELL_CANDIDATES = 32_768
CELL_QUERIES = 1024


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of whole doubles."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(~bad)
    return usable.select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: _floor(x * scale)).alias("v"))


def _floor(x: Column) -> Column:
    """As a double, also beyond the range of a long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


_LONGEST = 2**63 - 1


def _whole_scores(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products in whole numbers, kept within a long."""
    own = [int(x) for x in query]
    return [max(-_LONGEST - 1, min(_LONGEST, sum(a * int(b) for a, b in zip(own, v, strict=True)))) for v in vectors]


def best_of_cell(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(row of the query, candidate, score): for each query the k best candidates of another id, or all if fewer."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    dims = candidates.shape[1]
    # powers of two keep large components from overflowing; the order of sums doesn't change
    shift = [2.0 ** -max(0, int(np.frexp(np.abs(x).max(initial=0))[1]) - 400) for x in (queries, candidates)]
    columns = np.ascontiguousarray(candidates.T) * shift[1]
    squares = columns**2
    norms2 = squares.sum(axis=0)
    most = 2.0**63 * shift[0] * shift[1]
    slack = 4.0 * dims * np.finfo(float).eps
    out = []
    for row, (q, v) in enumerate(zip(query_ids.tolist(), queries * shift[0], strict=True)):
        by_mass = np.argsort(-np.abs(v), kind="stable")
        live = np.flatnonzero(ids != q)
        partial = np.zeros(len(live))
        rest = norms2[live]
        own = own_rest = float((v**2).sum())
        exact = max(shift) == 1.0 and own * norms2.max(initial=0) < 2.0**104
        rounding = np.zeros(len(live)) if exact else slack * np.sqrt(own * rest) + 1e-300
        for a in range(0, dims, block):
            use = by_mass[a : a + block]
            part = columns[use] if len(live) == len(ids) else columns[np.ix_(use, live)]
            partial = partial + v[use] @ part
            rest = rest - (part**2).sum(axis=0)
            own_rest -= float((v[use] ** 2).sum())
            if len(live) > k and (a + block < dims or not exact):
                mass = np.sqrt(np.maximum(rest, 0) * max(own_rest, 0)) * (1 + 1e-9) + rounding if a + block < dims else rounding
                mass = mass + (1e-6 if exact else slack * np.sqrt(own * norms2[live]))
                # what lies beyond a long is a tie there
                lower = np.clip(np.partition(partial - mass, len(live) - k)[len(live) - k], -most, most)
                keep = np.clip(partial + mass, -most, most) >= lower
                live, partial, rest, rounding = live[keep], partial[keep], rest[keep], rounding[keep]
        if not exact:
            scores = _whole_scores(queries[row], candidates[live])
            best = sorted(range(len(live)), key=lambda i: (-scores[i], i))[:k]
            out += [(row, int(ids[live[i]]), scores[i]) for i in best]
            continue
        if len(live) > k:  # ids are in order: a stable sort breaks ties by the smaller one
            bound = np.partition(partial, len(live) - k)[len(live) - k]
            live, partial = live[partial >= bound], partial[partial >= bound]
        best = np.argsort(-partial, kind="stable")[:k]
        out += [(row, int(ids[live[i]]), int(partial[i])) for i in best]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, cell_queries: int = CELL_QUERIES, cell_candidates: int = CELL_CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are (id, v) as ``integers`` makes them."""
    query_groups = max(1, -(-queries.count() // cell_queries))
    candidate_groups = max(1, -(-candidates.count() // cell_candidates))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.dropDuplicates(["id", "v"]).select("id", "v", F.xxhash64("v").alias("own"), F.size("v").alias("dims"), F.pmod(F.xxhash64("id", "v"), F.lit(query_groups)).cast("int").alias("qg"), spread(candidate_groups).alias("cg"))
    # dealt by row, as one id may have very many
    dealt = candidates.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(candidate_groups)).cast("int").alias("cg"))
    c = dealt.select("*", spread(query_groups).alias("qg"))

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        return np.array(rows["v"].tolist(), float).reshape(len(rows), -1)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = best_of_cell(matrix(left), left["id"].to_numpy(), matrix(right), right["id"].to_numpy(), k) if len(left) and len(right) else []
        at = [row for row, _, _ in found]
        return pd.DataFrame({"query_id": left["id"].to_numpy()[at], "own": left["own"].to_numpy()[at], "vec_id": [i for _, i, _ in found], "score": [s for _, _, s in found]}).astype("int64")

    keys = ["qg", "cg", "dims"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(cell, "query_id long, own long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbour_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns, for the queries whose vec_id is divisible by ``QUERY_EVERY``."""
    vectors = integers(embeddings)
    return top_k(vectors.where(F.pmod("id", F.lit(QUERY_EVERY)) == 0), vectors)
