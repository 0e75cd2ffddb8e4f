"""Nearest neighbours by a permutation index.

A vector is represented by the order of all pivots, nearest first. Vectors are dealt to blocks by hash, and a
block posts its members in pivot inverted files: the file of a pivot holds the pivot's place in each member's
order. A query reads the files, adds up how far its own places are from the members' (the footrule distance),
and the RERANK share of the block that is nearest by it is ranked again by inner product in double precision
on the original vectors. Each block gives its best, and the best of all blocks are the result.

Copies of a vector are one entry with its smallest ids, so that they neither fill a share nor cost more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.common import stored

#: Pivots at least (a bounded sample of the distinct vectors); they grow with the root of the number of vectors, up to
#: MOST_PIVOTS. The share of a block that is ranked again, and the least number of a block's entries for each result.
PIVOTS, MOST_PIVOTS, RERANK, LEAST = 256, 4096, 0.12, 4
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
#: Queries that are scored against a block at once.
QUERY_CHUNK = 256


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each pivot's place in each vector's order of pivots, nearest first (ties: lower pivot)."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def footrule(files: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The sum over pivots of how far a query's place is from each member's; a row of files is one pivot's file."""
    total, step = np.zeros(files.shape[1], np.int32), np.empty(files.shape[1], np.int16)
    # sums of 16 bits hold some pivots; then they go to the total
    run = np.empty(files.shape[1], np.uint16)
    most = max(1, 65535 // max(1, len(files)))
    for a in range(0, len(files), most):
        run[:] = 0
        for file, place in zip(files[a : a + most], query[a : a + most].tolist(), strict=True):
            np.subtract(file, place, out=step)
            np.abs(step, out=step)
            np.add(run, step.view(np.uint16), out=run)
        total += run
    return total


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    pivots: int | None = None,
    rerank: float = RERANK,
) -> DataFrame:
    """The k best rows for each query row: query_id, rank, vec_id, score.

    score is the inner product. Candidates are all rows with another id; ties go to the smaller id.
    Vectors that are null or zero, or hold null or non-finite components, take no part; shorter vectors
    count as padded with zeros. Rows of one id and several vectors are one candidate by their best score. With
    fewer than k candidates there are fewer rows. An empty table gives an empty result; other columns are ignored.

    The search is approximate, exact with rerank=1: neighbours beyond the share that the footrule picks are missed.
    pivots is max(PIVOTS, the root of the number of vectors) unless given.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    base = base.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    facts = base.agg(F.max(F.size("v")).alias("d"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if facts.d is None:
        return spark.createDataFrame([], schema)
    d, longest = facts.d, facts.m
    base = base.withColumn("h", F.xxhash64("v"))
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, int(np.sqrt(facts.n))))
    hashes = [r.h for r in base.select("h").distinct().orderBy("h").limit(pivots).collect()]
    few = spark.createDataFrame([(h,) for h in hashes], "h long")
    sample = base.join(F.broadcast(few), "h").select("h", "v").distinct().orderBy("h", "v").limit(pivots).collect()
    pad = lambda rows: np.array([list(r) + [0.0] * (d - len(r)) for r in rows], float).reshape(-1, d)

    def lifted(x: np.ndarray) -> np.ndarray:
        # inner product as nearness of unit vectors: one more component makes all equally long
        x = x / longest
        return np.column_stack((x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))))

    centre = lifted(pad([r.v for r in sample]))

    def index(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pad(batch.column("v").to_pylist())
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            up = np.column_stack((x / length, np.zeros(len(x)))) if asking else lifted(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "ids": batch.column("ids"),
                    "place": pa.array([r.tobytes() for r in places(up, centre)], pa.binary()),
                    "v": pa.array([r.tobytes() for r in x], pa.binary()),
                }
            )

    entry = "id long, ids array<long>, place binary, v binary"
    # of copies the k + 1 smallest ids are enough: one may be the query's own, and those with a better score elsewhere are in the result
    copies = base.withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    copies = copies.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v")
    posts = stored(copies.mapInArrow(lambda b: index(b, False), entry), "postings")
    askers = base.where("q").select("id", "v").distinct().select("id", F.array().cast("array<long>").alias("ids"), "v")
    asks = stored(askers.mapInArrow(lambda b: index(b, True), entry), "askers")
    vector_blocks, query_blocks = max(1, -(-posts.count() // VECTOR_BLOCK)), max(1, -(-asks.count() // QUERY_BLOCK))
    own_block = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filed = posts.select(own_block(vector_blocks, "v").alias("vb"), upto(query_blocks).alias("qb"), F.lit(0).alias("side"), "id", "ids", "place", "v")
    asked = asks.select(upto(vector_blocks).alias("vb"), own_block(query_blocks, "id").alias("qb"), F.lit(1).alias("side"), "id", "ids", "place", "v")
    parts = max(1, min(vector_blocks * query_blocks, max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    dealt = filed.union(asked).repartition(parts, "vb", "qb").sortWithinPartitions("vb", "qb", "side", "id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            side = table["side"].to_numpy()
            n = int(np.count_nonzero(side == 0))
            if n == 0 or n == len(side):
                continue
            ids = table["id"].to_numpy()
            members = table["ids"].combine_chunks()
            owned = members.value_lengths().to_numpy(zero_copy_only=False)[:n].astype(np.int64)
            members = members.flatten().to_numpy()
            place = np.frombuffer(b"".join(table["place"].to_pylist()), np.int16).reshape(len(side), -1)
            files = np.ascontiguousarray(place[:n].T)
            x = np.frombuffer(b"".join(table["v"].to_pylist()), float).reshape(len(side), -1)
            take = min(n, max(LEAST * k, int(np.ceil(rerank * n))))
            for a in range(n, len(side), QUERY_CHUNK):
                b = min(a + QUERY_CHUNK, len(side))
                scores = np.full((b - a, n), -np.inf)
                for i in range(a, b):
                    # a file is in order of id; all that are as near as the last one taken are taken too
                    far = footrule(files, place[i])
                    near = np.flatnonzero(far <= np.partition(far, take - 1)[take - 1]) if take < n else np.arange(n)
                    scores[i - a, near] = x[near] @ x[i]
                found = _best(scores, x[a:b], x[:n], ids[a:b], owned, members, k, longest)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    near = dealt.mapInArrow(rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, asking: np.ndarray, owned: np.ndarray, members: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids for each query of those that own the vectors x: ids of queries, ids, scores.

    scores are the products of all, -inf for those that take no part. They choose who is near; as their last bits
    depend on the shape of a block, those near are scored again one by one.
    """
    n = len(x)
    slack = 1e-10 * longest * np.sqrt((q * q).sum(axis=1))
    first = np.cumsum(owned) - owned
    out, todo, want = [], np.arange(len(q)), min(n, k + 1)
    while len(todo):
        part = scores[todo]
        least = np.partition(part, n - want, axis=1)[:, n - want]
        row, col = np.nonzero((part >= (least - slack[todo])[:, None]) & (part > -np.inf))
        score = np.einsum("ij,ij->i", x[col], q[todo[row]])
        size = owned[col]
        at = np.repeat(first[col] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, score, ids = np.repeat(row, size), np.repeat(score, size), members[at]
        other = ids != asking[todo[row]]
        row, score, ids = row[other], score[other], ids[other]
        # an id counts once, by its best score
        by = np.lexsort((-score, ids, row))
        row, score, ids = row[by], score[by], ids[by]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, score, ids = row[once], score[once], ids[once]
        by = np.lexsort((ids, -score, row))
        row, score, ids = row[by], score[by], ids[by]
        sure = np.bincount(row[score >= (least - slack[todo] / 2)[row]], minlength=len(todo))
        done = (sure >= k) | (want == n)
        best = done[row] & (np.arange(len(row)) - np.searchsorted(row, row) < k)
        out.append((asking[todo[row[best]]], ids[best], score[best]))
        todo, want = todo[~done], min(n, 4 * want)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell of a partition, which is sorted by cell."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        cell = np.column_stack([batch.column(c).to_numpy() for c in ("vb", "qb")])
        cuts = [0, *(np.flatnonzero((np.diff(cell, axis=0) != 0).any(axis=1)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b <= a:
                continue
            now = tuple(cell[a].tolist())
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
