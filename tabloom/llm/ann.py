"""Operator 6: nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import materialize

#: Vectors that codes and radius are fitted on, and of those the ones searched for to fix the radius, at most.
FIT_ROWS, FIT_QUERIES = 8_192, 256
#: Bits of a code at most, and bits of a substring.
BITS, PART = 64, 8
#: Share of the fitting sample's true neighbours that the radius must take in. Among more vectors neighbours are nearer.
WITHIN = 0.985
#: Vectors in a block of the index, and queries in a block of queries, at most about so many.
BLOCK, QUERIES = 65_536, 4_096

_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


@dataclass
class Codes:
    """Codes are the signs of (x / |x| - mean) @ turn; `radius` is the Hamming distance to search within."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        on = (unit(x) - self.mean) @ self.turn > 0
        return np.packbits(np.pad(on, ((0, 0), (0, BITS - self.bits))), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, k: int, rounds: int = 30) -> Codes:
    """Iterative quantisation: principal axes, then the rotation that brings the projections nearest to their signs."""
    n, dims = x.shape
    bits = min(BITS, dims)
    u = unit(x) if n else np.zeros((0, dims))
    mean = u.mean(axis=0) if n else np.zeros(dims)
    _, _, axes = np.linalg.svd((u - mean).T @ (u - mean) if n else np.eye(dims))
    v = (u - mean) @ axes[:bits].T
    turn = np.linalg.qr(np.random.default_rng(6).normal(size=(bits, bits)))[0]
    for _ in range(rounds if n else 0):
        a, _, b = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
        turn = a @ b
    codes = Codes(mean, axes[:bits].T @ turn, bits)
    if n > k + 1:
        words = codes.of(x).view(">u8")[:, 0]
        found = []
        for i in np.random.default_rng(7).choice(n, min(n, FIT_QUERIES), replace=False):
            score = u @ u[i]
            score[i] = -2
            best = np.argpartition(-score, k)[:k]
            found.append(np.bitwise_count(words[best] ^ words[i]))
        codes.radius = int(np.quantile(np.concatenate(found), WITHIN, method="higher"))
    return codes


class Index:
    """A block of codes, with a table for each substring that lists the codes by their value there."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.parts = -(-bits // PART)
        self.codes = codes
        self.words = codes.view(np.uint64)[:, 0]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.parts)]
        self.ends = [np.cumsum(np.bincount(codes[:, j], minlength=256)) for j in range(self.parts)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all codes at `radius` or fewer differing bits.

        With radius = parts * s + a such a code differs in at most s bits in one of the first a + 1 substrings, or in at
        most s - 1 in one of the others; so it is in one of the buckets that are probed.
        """
        s, a = divmod(radius, self.parts)
        seen = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            reach = s if j <= a else s - 1
            if reach < 0:
                continue
            buckets = np.flatnonzero(_NEAR[code[j]] <= reach)
            ends = self.ends[j][buckets]
            sizes = np.diff(self.ends[j], prepend=0)[buckets]
            at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.words[found] ^ code.view(np.uint64)[0]) <= radius]


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row an id: of rows with one id the smallest vector."""
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks()
    x = (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False)
    x = x.reshape(len(ids), -1).astype(float)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, x = ids[order], x[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], x[first]


def _search(codes: Codes, k: int, radius: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(rows) and len(queries):
            ids, x = _vectors(rows)
            index = Index(codes.of(x), codes.bits)
            norms = np.sqrt((x * x).sum(axis=1))
            qids, q = _vectors(queries)
            for qid, v, code in zip(qids.tolist(), q, codes.of(q)):
                near = index.within(code, radius)
                near = near[ids[near] != qid]
                score = (x[near] * v).sum(axis=1) / (norms[near] * np.sqrt((v * v).sum()))
                best = np.lexsort((ids[near], -score))[:k]
                out[0] += [qid] * len(best)
                out[1] += ids[near[best]].tolist()
                out[2] += score[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(vector: str) -> Column:
    """Holds for vectors that have a direction: not null, without null or non-finite components, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row with is_query its k nearest other rows by cosine: query_id, rank (from 1), vec_id, score.

    Found are the k nearest among all rows whose codes differ from the query's in at most `radius` bits, which is
    fitted on a sample of up to FIT_ROWS rows to take in WITHIN of the true neighbours there. A query with fewer than k
    such rows is searched again among all rows, so it always gets k, or as many as there are. Scores are cosines of the
    original vectors in double precision; equal ones go to the smaller key.

    Vectors that aren't usable(), have a null key, or another length than most vectors take no part; rows that repeat
    a key count once, by their smallest vector. Empty tables give no rows.

    Rows and queries are dealt into blocks by a hash of the key, each pair of blocks is one task's index and queries,
    and each query brings k rows from each block. Equal vectors are spread evenly, and no block grows with the input.
    """
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("q"), 1)).alias("queries"))
    most = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    if not most:
        return rows.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dims, n, queries = most[0]
    rows = rows.where(F.size("v") == dims)
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id", "v").limit(FIT_ROWS).toArrow()
    codes = fit(_vectors(sample)[1], k)

    blocks = max(-(-n // BLOCK), min(16, -(-n // 2_048)))
    qblocks = max(1, -(-queries // QUERIES))
    place = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def search(asked: DataFrame, radius: int) -> DataFrame:
        """Each query's best k rows of each block, then of all."""
        left = rows.select("vec_id", "v", place("block", blocks).alias("b"), all_of(qblocks).alias("a")).groupBy("b", "a")
        right = asked.select("vec_id", "v", all_of(blocks).alias("b"), place("ask", qblocks).alias("a")).groupBy("b", "a")
        got = left.cogroup(right).applyInArrow(_search(codes, k, radius), "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return got.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    asked = rows.where("q").select("vec_id", "v")
    found = materialize(search(asked, codes.radius))
    full = found.where(F.col("rank") == k).select("query_id")
    short = materialize(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return found
    again = search(short, BITS)
    kept = found.join(full.withColumnRenamed("query_id", "__f"), F.col("query_id") == F.col("__f"), "left_semi")
    return kept.unionByName(again)
