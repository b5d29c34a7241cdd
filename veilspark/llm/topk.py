"""Operator 2: exact top-k inner products by Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

BLOCK = 4096  # candidates whose lists one task holds, at least (where there are as many)
BLOCK_CELLS = 1 << 22  # components of a block, at most: 65,536 candidates of 64 components
FIRST_STEP, GROWTH = 32, 2.0  # entries read of a list at first, and how much more each time
SPREAD = 0.9  # share of the candidates' squared length that the lists read apart must hold
_EXACT = 1 << 53
_MAX = (1 << 63) - 1


def quantised(vectors: DataFrame, ident: str, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, v (floor of scale times each component as a double, array of double), where neither the id, the
    vector nor a component is null, NaN or infinite."""
    ok = F.col(ident).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(ok).select(F.col(ident).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))


class Lists:
    """A block of candidates as lists sorted by value, largest first.

    The lists are those of the block's leading principal axes, and one of the lengths of what the axes leave over:
    an inner product is at most the sum over the axes plus the product of the two lengths left over. The axes serve
    the bound alone; scores are inner products of the whole numbers given.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        size, axes = np.linalg.eigh(self.x.T @ self.x)
        size, self.axes = np.maximum(size[::-1], 0), axes[:, ::-1]
        upto = np.cumsum(size)
        self.lead = int(np.searchsorted(upto, SPREAD * upto[-1])) + 1 if len(upto) and upto[-1] > 0 else 0
        y = self.x @ self.axes
        rest = np.sqrt((y[:, self.lead :] ** 2).sum(axis=1))
        y = np.column_stack([y[:, : self.lead], rest])
        self.lists = np.argsort(-y, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(y, self.lists, axis=0)
        self.length = float(np.sqrt((self.x**2).sum(axis=1)).max(initial=0))
        self.scored = self.offered = 0

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold whole numbers under 2^53, beyond that Python's integers count."""
        x = self.x[rows]
        if len(q) * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < _EXACT:
            return (x @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([min(_MAX, max(-_MAX - 1, sum(int(a) * b for a, b in zip(r, whole)))) for r in x.tolist()], np.int64)

    def top(self, query: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than the query's own rows, ties to the smaller id; those
        that score under least may be left out.

        All lists are read downwards (upwards where the query's component is negative), further where that lowers
        the bound most, and each candidate met is scored in full. Reading stops when the bound is less than least
        or than the k-th best score: the largest inner product that is left for a candidate not met yet, which
        holds at most the last value read in every list and is no longer than the longest candidate. Equal to it
        is not enough: a candidate not met yet could tie with a smaller id. Without a stop all are met.
        """
        n = len(self.ids)
        y = q @ self.axes
        y = np.append(y[: self.lead], np.sqrt((y[self.lead :] ** 2).sum()))
        use = np.flatnonzero(y)
        down, weight = y[use] > 0, np.abs(y[use])
        def value(place: np.ndarray) -> np.ndarray:  # largest first, for weights above zero
            place = np.minimum(place, n - 1)
            return np.where(down, 1.0, -1.0) * self.values[np.where(down, place, n - 1 - place), use]

        slack = 1e-9 * (self.length * float(np.sqrt(q @ q)) + 1)
        seen, best, score = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = np.zeros(len(use), np.int64), FIRST_STEP
        self.offered += n
        while not seen.all():
            floor = max(least, float(score.min())) if len(best) == k else least
            if len(use) and self._bound(value(at), weight) + slack < floor:
                break
            if len(use):
                to = np.minimum(at + step, n)
                gain = weight * (value(at) - value(to - 1))
                read = (gain >= gain.mean()) & (to > at)
                if not read.any():
                    read = to > at
                place = np.minimum(at[read][:, None] + np.arange(step), n - 1)
                met = self.lists[np.where(down[read][:, None], place, n - 1 - place), use[read][:, None]].ravel()
                at = np.where(read, to, at)
                fresh = np.zeros(n, bool)
                fresh[met] = True
                rows = np.flatnonzero(fresh & ~seen)
                step = int(step * GROWTH) + 1
            else:
                rows = np.flatnonzero(~seen)
            seen[rows] = True
            self.scored += len(rows)
            rows = rows[self.ids[rows] != query]
            best, score = np.concatenate([best, rows]), np.concatenate([score, self.scores(rows, q)])
            if len(best) > k:
                kept = np.lexsort((self.ids[best], -score))[:k]
                best, score = best[kept], score[kept]
        order = np.lexsort((self.ids[best], -score))
        return self.ids[best][order], score[order]

    def _bound(self, last: np.ndarray, weight: np.ndarray) -> float:
        """The largest sum of weight times x over all x of at most last in each place and of at most the longest
        candidate's length: x is the weights times one factor, cut at last; the factor is where the length is
        reached (Li et al., Cosine Threshold Queries, 2019)."""
        room = self.length**2 * (1 + 1e-9) - float((last[last < 0] ** 2).sum())
        if room < 0:
            return -np.inf
        cut = np.maximum(last, 0)
        order = np.argsort(cut / weight, kind="stable")
        c, w = cut[order], weight[order]
        full = np.concatenate([[0.0], np.cumsum(c * c)])  # of those cut
        free = np.concatenate([np.cumsum((w * w)[::-1])[::-1], [0.0]])  # of those not cut
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.sqrt(np.maximum(room - full, 0) / free)
        hit = np.flatnonzero(factor[:-1] * w <= c)  # the first place from which on nothing more is cut
        if not len(hit):
            return float(last @ weight)
        i = int(hit[0])
        return float(c[:i] @ w[:i] + factor[i] * free[i] + last[last < 0] @ weight[last < 0])


def _padded(vs: list, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v[:width]
    return out


def _search(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of block, a block's candidates before its queries: one block is held at a time."""
        block, ids, vs, lists = None, [], [], None
        for p in parts:
            out: list[tuple[int, int, int]] = []
            for b, kind, i, v, least in zip(p["block"].tolist(), p["kind"].tolist(), p["vec_id"].tolist(), p["v"], p["least"].tolist()):
                if b != block:
                    block, ids, vs, lists = b, [], [], None
                if kind == 0:
                    ids.append(i)
                    vs.append(v)
                    continue
                if not ids:
                    continue
                if lists is None:
                    lists = Lists(np.array(ids, np.int64), _padded(vs, max(map(len, vs))))
                found, score = lists.top(i, _padded([v], lists.x.shape[1])[0], k, least)
                out += zip([i] * len(found), found.tolist(), score.tolist())
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])

    return run


def _first_scores(k: int, shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with its k-th best score among the first block's candidates: no less can be in its result."""
        lists = None
        for p in parts:
            if lists is None:
                ids, vs = shared.value
                lists = Lists(np.array(ids, np.int64), _padded(vs, max(map(len, vs), default=0)))
            out = []
            for i, v in zip(p["vec_id"].tolist(), p["v"]):
                score = lists.top(i, _padded([v], lists.x.shape[1])[0], k)[1]
                out.append(float(score[-1]) if len(score) == k else -np.inf)
            yield pd.DataFrame({"vec_id": p["vec_id"], "v": p["v"], "least": out})

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product for each row whose id is
    divisible by every, ties to the smaller id; fewer if there are fewer candidates.

    Rows with the query's id are no candidates of it. Vectors that are null or hold null, NaN or infinite
    components take no part; of vectors of unequal length the shorter counts as filled with zeros (vectors may be
    of any length: a block holds at most BLOCK_CELLS components of its longest ones, or one vector); scores beyond
    a long are set to its ends. Candidates of one id with equal vectors count each; a repeated query gives one
    result. An empty table gives an empty result; other columns are left alone, whatever their names.

    Candidates are dealt into blocks by a hash of their id (repeated ids go by their vector), as large as a task's
    memory allows, since each query is sent to every block: what moves is the vectors once and the queries once for
    each block, one copy for each 65,536 candidates of 64 components. A bounded sample of candidates, one block,
    goes to all executors first and gives each query a score that its result cannot fall below, so that every block
    stops reading as soon as it cannot beat that.
    """
    rows = written(quantised(vectors, ident, vector), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, BLOCK_CELLS // max(1, width or 1))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // most), min(2 * parallel, -(-n // min(BLOCK, most))))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    cand = rows.select(place.alias("block"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(float("-inf")).alias("least"))
    seed = rows.select("vec_id", "v").limit(min(BLOCK, most)).collect()
    shared = rows.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in seed], [r["v"] for r in seed]))
    ask = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    ask = ask.mapInPandas(_first_scores(k, shared), "vec_id long, v array<double>, least double")
    ask = ask.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "least")
    dealt = cand.unionByName(ask).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    found = dealt.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
