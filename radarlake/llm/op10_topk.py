"""Exact top-k inner-product search by a three-phase uniform threshold.

The lists are partial scores: each vector's components fall into ``LISTS`` equal parts,
and a block of rows holds its stretch of every list. Rows of a block are dealt to cells
of near vectors, and each cell keeps a centre and a radius a part, so a
list's largest possible score in a cell is known without scoring it: the list is walked
by falling bounds.

1. Each block sends, for each query, the exact scores of a few rows: those at the top of
   each list in the cell of the highest bound, and 2k in all blocks together. The k-th
   best of all is a safe cutoff, as no more than k rows lie above the true one.
2. The cutoff goes back with the queries. A row that reaches it has at least one part of
   cutoff / LISTS or more (the uniform threshold), so each list is walked down to that,
   and only in cells whose bounds together reach the cutoff.
3. Of the rows found so, and of no others, the missing parts are looked up, the scores
   are exact, and what lies below the cutoff goes. The k best of each block meet once
   more.

Rows stay where they are once dealt into blocks. Queries go out by broadcast, packed, at
most ``CHUNK`` at a time, so what is broadcast has a bound and what is shuffled are
cutoffs and entries, a few for each query and block.

Edge cases: vectors meet only those of their length (empty ones score 0); those null or
with null or non-finite components take no part; a null id takes no part; rows may
repeat: every row but the query's own is a candidate, and each row whose id is a query
asks for itself; scores beyond 64 bits are ranked exactly and given as the nearest long;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import discard, frugal, materialize, workers_can_import

TOP = 20
LISTS = 2
SCALE = 64
#: Queries in one broadcast (8 MB of 64 components), in one matrix, rows in a block and in a cell.
CHUNK = 65_536
QUERY_BLOCK = 1024
ROW_BLOCK = 16_384
CELL = 128
LOW = 1 - (1 << 63)


def quantized(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(64 x) of each component; unusable vectors are left out."""
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    got = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    got = got.filter("id IS NOT NULL AND x IS NOT NULL").filter(~bad)
    return got.select("id", F.transform("x", lambda c: F.when(F.abs(c * SCALE) < 2.0**52, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE)).alias("v"))


def packed(df: DataFrame, parts: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (uid, id, v): (part, dim, n, wide, uids, ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def out(d):
            uids, ids, vecs = held.pop(d)
            data = np.array(vecs, dtype="<f8").reshape(len(ids), d)
            wide = bool(np.abs(data).max(initial=0) >= 1 << 15)
            raw = data.tobytes() if wide else data.astype("<i2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((d, pa.int32()), (len(ids), pa.int32()), (wide, pa.bool_()), (np.array(uids, "<i8").tobytes(), pa.binary()), (np.array(ids, "<i8").tobytes(), pa.binary()), (raw, pa.binary()))], names=["dim", "n", "wide", "uids", "ids", "data"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                at = held.setdefault(len(row[2]), ([], [], []))
                for x, y in zip(at, row, strict=True):
                    x.append(y)
                if len(at[0]) == size:
                    yield out(len(row[2]))
        for d in list(held):
            yield out(d)

    got = df.select("uid", "id", "v").repartition(parts).mapInArrow(frugal(run), "dim int, n int, wide boolean, uids binary, ids binary, data binary")
    return got.withColumn("part", F.spark_partition_id())


def _matrix(raw: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8" if wide else "<i2").reshape(n, dim).astype(np.float64)


def _parts(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, max(min(LISTS, dim), 1) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cells(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of cells of at most CELL near vectors: each set is split between two far rows.

    The cut is halfway between the two, or the median if that leaves under 1/16 on a side.
    """
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= CELL or not x.shape[1]:
            out += [rows[k : k + CELL] for k in range(0, len(rows), CELL)]
            continue
        v = x[rows]
        a = v[((v - v.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = v[((v - a) ** 2).sum(axis=1).argmax()]
        along = v @ (b - a)
        right = along > ((a + b) / 2) @ (b - a)
        if min(right.sum(), len(rows) - right.sum()) * 16 < len(rows):
            right = np.zeros(len(rows), dtype=bool)
            right[np.argsort(along, kind="stable")[len(rows) // 2 :]] = True
        todo += [rows[right], rows[~right]]
    return out


class Block:
    """The rows of a block, its cells and their bounds."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        self.x, self.ids, self.uids = x, ids, uids
        self.cells, self.parts = cells(x), _parts(x.shape[1])
        self.most = float(np.abs(x).max(initial=0))
        self.scored = 0  # pairs of a query and a row of which a part was computed
        self.centres = np.array([x[c].mean(axis=0) for c in self.cells]).reshape(len(self.cells), x.shape[1])
        self.radius = [np.array([np.sqrt(((x[c, s] - m[s]) ** 2).sum(axis=1)).max() for c, m in zip(self.cells, self.centres, strict=True)]) for s in self.parts]

    def exact(self, q: np.ndarray) -> bool:
        """Whether floats hold every sum; beyond that all rows are scored in Python's integers."""
        return float(np.abs(q).max(initial=0)) * self.most * max(q.shape[1], 1) < 2**53

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Of each list: no row of a cell (column) scores more for a query (row)."""
        out = []
        for s, r in zip(self.parts, self.radius, strict=True):
            size = np.sqrt((q[:, s] ** 2).sum(axis=1))[:, None]
            reach = size * (np.sqrt((self.centres[:, s] ** 2).sum(axis=1)) + r)
            out.append(q[:, s] @ self.centres[:, s].T + size * r + 1e-9 * reach + 1e-6)
        return out

    def whole(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of pairs: what parts are missing is looked up."""
        return np.concatenate([np.einsum("ij,ij->i", q[i[k : k + 65_536]], self.x[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)]).astype(np.int64) if len(i) else np.array([], dtype=np.int64)

    def first(self, q: np.ndarray, own: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, score): exact scores of ``few`` rows or less from the top of each query's lists."""
        best = sum(self.bounds(q)).argmax(axis=1)
        qi, score = [], []
        for c in np.unique(best):
            rows, i = self.cells[c], np.flatnonzero(best == c)
            take = min(few + 1, len(rows))  # the query itself may be among them
            seen = [np.argpartition(-(q[i, s] @ self.x[rows, s].T), take - 1, axis=1)[:, :take] for s in self.parts]
            self.scored += len(i) * len(rows)
            pairs = np.unique(np.concatenate([np.arange(len(i))[:, None] * len(rows) + x for x in seen], axis=1).ravel())
            a, j = i[pairs // len(rows)], rows[pairs % len(rows)]
            ok = self.uids[j] != own[a]
            a, j = a[ok], j[ok]
            s = self.whole(q, a, j)
            order = np.lexsort((-s, a))
            a, s = a[order], s[order]
            nth = np.arange(len(a)) - np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], np.arange(len(a)), 0)) if len(a) else a
            qi.append(a[nth < few])
            score.append(s[nth < few])
        return np.concatenate(qi), np.concatenate(score)

    def second(self, q: np.ndarray, own: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows at the cutoff or above."""
        bounds = self.bounds(q)
        able = sum(bounds) >= cut[:, None]
        uniform = np.where(cut == LOW, -np.inf, np.ceil(cut / len(self.parts) - 1e-9 * np.abs(cut)))
        a, j, s = (np.array([], dtype=np.int64) for _ in range(3))
        for c, rows in enumerate(self.cells):
            pairs = []
            touched = np.zeros(len(q), dtype=bool)
            for part, bound in zip(self.parts, bounds, strict=True):
                i = np.flatnonzero(able[:, c] & (bound[:, c] >= uniform))  # else the list is lower in all of the cell
                if len(i):
                    touched[i] = True
                    at, row = np.nonzero(q[i, part] @ self.x[rows, part].T >= uniform[i, None])
                    pairs.append(i[at] * len(rows) + row)
            self.scored += int(touched.sum()) * len(rows)
            if pairs:
                pair = np.unique(np.concatenate(pairs))
                i, row = pair // len(rows), rows[pair % len(rows)]
                got = self.whole(q, i, row)
                ok = (got >= cut[i]) & (self.uids[row] != own[i])
                a, j, s = (np.concatenate(x) for x in ((a, i[ok]), (j, row[ok]), (s, got[ok])))
            if len(a) > 4 * k * len(q) or c == len(self.cells) - 1:
                order = np.lexsort((self.ids[j], -s, a))
                a, j, s = a[order], j[order], s[order]
                nth = np.arange(len(a)) - np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], np.arange(len(a)), 0)) if len(a) else a
                a, j, s = a[nth < k], j[nth < k], s[nth < k]
        return a, j, s

    def all_of(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(row, score) of the k best rows for one query, in Python's integers."""
        v = [int(c) for c in q]
        scores = [(sum(a * int(b) for a, b in zip(v, x, strict=True)), int(self.ids[r]), r) for r, x in enumerate(self.x) if self.uids[r] != own]
        self.scored += len(self.x)
        return [(r, s) for s, _, r in sorted(scores, key=lambda t: (-t[0], t[1]))[:k]]


def _sortable(n: int) -> bytes:
    """Bytes in the order of the integers."""
    size = (n.bit_length() + 8) // 8
    raw = (n if n >= 0 else n + (1 << 8 * size)).to_bytes(size, "big")
    return (b"\x01" + size.to_bytes(4, "big") if n >= 0 else b"\x00" + ((1 << 32) - 1 - size).to_bytes(4, "big")) + raw


def _long(n: int) -> int:
    return min(max(n, LOW), (1 << 63) - 1)


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): for each row that is a query, the k best other rows.

    ``is_query``: a condition on the id column.
    """
    workers_can_import(df.sparkSession)
    vecs = materialize(quantized(df, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()))
    asked = vecs.withColumn(id_col, F.col("id")).filter(is_query)
    n, many = vecs.count(), asked.count()
    rows = materialize(packed(vecs, max(1, -(-n // ROW_BLOCK)), ROW_BLOCK))
    chunks = max(1, -(-many // CHUNK))
    queries = materialize(packed(asked, chunks, QUERY_BLOCK))
    blocks = max(1, -(-n // ROW_BLOCK))
    few = max(2, -(-2 * k // blocks))
    left = rows.select("dim", "n", "wide", "uids", "ids", "data").repartition(blocks)
    # blocks of rows stay in their tasks: each meets all queries of the chunk
    told = []
    for c in range(chunks):
        now = queries.filter(F.col("part") == c)
        cut = _cutoffs(left, now, k, few)
        entries = _entries(left, now, cut, k)
        told.append(materialize(entries) if chunks > 1 else entries)
    entries = reduce(DataFrame.unionByName, told)
    order = F.row_number().over(_window("uid", F.desc("score"), F.desc_nulls_last("big"), F.asc("id")))
    got = entries.withColumn("rank", order).filter(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    if chunks > 1:
        discard(rows, queries)
    return got


def _met(left: DataFrame, queries: DataFrame) -> DataFrame:
    qs = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("dim", "part")))
    return left.join(F.broadcast(qs), "dim")  # at most CHUNK queries


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, np.ndarray, np.ndarray]]:
    """(row, block of rows, queries, their uids); a block that comes again is not made again."""
    last: tuple = (None, None)
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            if last[0] != (r["uids"], r["data"]):
                last = (r["uids"], r["data"]), Block(_matrix(r["data"], r["n"], r["dim"], r["wide"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["uids"], "<i8"))
            yield r, last[1], _matrix(r["q_data"], r["q_n"], r["dim"], r["q_wide"]), np.frombuffer(r["q_uids"], "<i8")


def _cutoffs(left: DataFrame, queries: DataFrame, k: int, few: int) -> DataFrame:
    """(uid, cut) of the queries for which k rows were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, q, own in _blocks(batches):
            if block.exact(q):
                a, s = block.first(q, own, few)
                yield pa.RecordBatch.from_arrays([pa.array(own[a], pa.int64()), pa.array(s, pa.int64())], names=["uid", "score"])

    sent = _met(left, queries).mapInArrow(frugal(run), "uid long, score long")
    rank = F.row_number().over(_window("uid", F.desc("score")))
    return sent.withColumn("r", rank).filter(f"r = {k}").select("uid", F.col("score").alias("cut"))


def _entries(left: DataFrame, queries: DataFrame, cut: DataFrame, k: int) -> DataFrame:
    """(uid, query_id, id, score, big) of the rows at the cutoffs or above; big orders scores beyond 64 bits."""
    spread = queries.withColumn("block", F.xxhash64("uids")).select("block", "uids").mapInArrow(frugal(_spread), "block long, uid long, at int")
    back = spread.join(cut, "uid", "left").groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cut"))), lambda s: s["cut"]).alias("cuts"))
    told = queries.withColumn("block", F.xxhash64("uids")).join(back, "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "query_id", "id", "score", "big"]
        for r, block, q, own in _blocks(batches):
            qid = np.frombuffer(r["q_ids"], "<i8")
            if block.exact(q):
                cuts = np.array([LOW if c is None else c for c in r["q_cuts"]], dtype=np.int64)
                a, j, s = block.second(q, own, cuts, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(qid[a]), pa.array(block.ids[j]), pa.array(s, pa.int64()), pa.nulls(len(a), pa.binary())], names=names)
                continue
            for a in range(len(q)):
                got = block.all_of(q[a], int(own[a]), k)
                cols = [[int(own[a])] * len(got), [int(qid[a])] * len(got), [int(block.ids[j]) for j, _ in got], [_long(s) for _, s in got], [_sortable(s) for _, s in got]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (*(pa.int64(),) * 4, pa.binary()), strict=True)], names=names)

    return _met(left, told).mapInArrow(frugal(run), "uid long, query_id long, id long, score long, big binary")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uids = np.frombuffer(raw, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(uids), pa.int64()), pa.array(uids, pa.int64()), pa.array(range(len(uids)), pa.int32())], names=["block", "uid", "at"])


def _window(by: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


def query(spark, sf_dir: str) -> DataFrame:
    got = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.rid, e.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: q.v[i] * e.v[i])), 0) AS BIGINT) AS score
      FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.rid <> q.rid AND len(e.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
