"""SimHash near-dedup by a binary trie self-join.

Equal fingerprints are one class (a partial aggregate, so copies never meet in a
task). Two fingerprints at most two bits apart agree on one of three bit blocks, so
each class goes out three times, rotated so that the block comes first; values with
the same leading block are a node of a binary trie. Each task walks its trie in
pairs of nodes: it starts from (node, node), splits both by the next bit, adds the
bits that differ, and drops a pair beyond the budget. It returns a spanning forest
of its links, never all pairs. A block value that holds very many classes is dealt
again by the pairs of nodes some levels further down.

Edge cases: a null text counts as empty (fingerprint 0); rows with a null id are kept
and take part, but never name a component (null if nothing else does); repeated rows
are one class; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import attach, components, frugal, materialize, workers_can_import

BUDGET = 2
SHINGLE = 3
SEED = 42
#: (bits to rotate left by, width of the leading block)
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A block value with more classes than this (or 1 in 65,536 of all) is dealt again.
HOT_NODES = 65_536
FRONTIER = 1 << 20
#: A column name that documents do not use.
OTHER = "__radarlake_id"


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of a text's 3-word shingles, as a signed 64-bit integer."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    join = b" ".join
    got = [xxh(join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)] if len(words) >= SHINGLE else [xxh(join(words), SEED)]
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.array(got, dtype=np.uint64).astype(">u8")
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(got)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp)"""
    workers_can_import(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    return src.mapInArrow(frugal(run), f"id {src.schema['id'].dataType.simpleString()}, fp long")


def trie_links(v: np.ndarray, front: tuple, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the sorted distinct values v within the budget, reached from the frontier.

    front: arrays (a0, a1, b0, b1, err) of node pairs at ``depth``, each node a range of v.
    """
    todo = [(depth, *front)]
    while todo:
        d, a0, a1, b0, b1, err = todo.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            todo += [(d, *(x[:half] for x in (a0, a1, b0, b1, err))), (d, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        na, nb = a1 - a0, b1 - b0
        own = a0 == b0
        keep = (na > 0) & (nb > 0) & (err <= budget) & ~(own & (na == 1))
        few = keep & ((na * nb <= 16) | (d == 64))
        if few.any():
            fa, fb, wa, wb = a0[few], b0[few], na[few], nb[few]
            each = wa * wb
            pair = np.repeat(np.arange(len(fa)), each)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            i, j = fa[pair] + at // wb[pair], fb[pair] + at % wb[pair]
            ok = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if ok.any():
                yield i[ok], j[ok]
        keep &= ~few
        if not keep.any():
            continue
        a0, a1, b0, b1, err, own = (x[keep] for x in (a0, a1, b0, b1, err, own))
        bit = np.uint64(63 - d)

        def middle(lo, hi, bit=bit):
            first = ((v[lo] >> bit) | np.uint64(1)) << bit
            return np.clip(np.searchsorted(v, first), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        cross = ~own
        todo.append((
            d + 1,
            np.concatenate([a0, am, a0, am[cross]]), np.concatenate([am, a1, am, a1[cross]]),
            np.concatenate([b0, bm, bm, b0[cross]]), np.concatenate([bm, b1, b1, bm[cross]]),
            np.concatenate([err, err, err + 1, err[cross] + 1]),
        ))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let label[x] be the smallest index linked to x, with the links i-j added."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _rotated(x: np.ndarray, left: int) -> np.ndarray:
    return x if not left else (x << np.uint64(left)) | (x >> np.uint64(64 - left))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition: (a, b) fingerprints, b the root of a in the task's forest."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    blk, fp, sub, p, q = (t.column(c).to_numpy() for c in ("blk", "fp", "bits", "p", "q"))
    fp = fp.astype(np.int64).view(np.uint64)
    for k, (left, width) in enumerate(BLOCKS):
        mine = blk == k
        for key in np.unique(np.stack([sub[mine], p[mine], q[mine]], axis=1), axis=0) if mine.any() else ():
            s, x, y = map(int, key)
            here = mine & (sub == s) & (p == x) & (q == y)
            v = np.unique(_rotated(fp[here], left))
            deep = width + s
            nodes = v >> np.uint64(64 - deep)
            lo = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            hi = np.r_[lo[1:], len(v)]
            zero = np.zeros(len(lo), dtype=np.int64)
            if x == y:
                front = (lo, hi, lo, hi, zero)
            else:  # pairs of the two sub-nodes of each block value
                top = nodes[lo] >> np.uint64(s)
                two = np.flatnonzero(top[1:] == top[:-1])
                front = (lo[two], hi[two], lo[two + 1], hi[two + 1], zero[two] + int(x ^ y).bit_count())
            label = np.arange(len(v))
            for i, j in trie_links(v, front, deep):
                merge(label, i, j)
            far = np.flatnonzero(label != np.arange(len(v)))
            if len(far):
                back = _rotated(v, (64 - left) % 64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(back[far]), pa.array(back[label[far]])], names=["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """A forest (a, b) of the links between distinct fingerprints (column fp)."""
    rotated = [f"struct({k} AS blk, shiftrightunsigned({f'(shiftleft(fp, {r}) | shiftrightunsigned(fp, {64 - r}))' if r else 'fp'}, {64 - w}) AS node, {f'(shiftleft(fp, {r}) | shiftrightunsigned(fp, {64 - r}))' if r else 'fp'} AS rot)" for k, (r, w) in enumerate(BLOCKS)]
    dealt = classes.select("fp", F.expr(f"inline(array({', '.join(rotated)}))"))
    sizes = materialize(dealt.groupBy("blk", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_NODES))
    if sizes.isEmpty():
        cold = dealt.select("blk", "node", "fp", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
        return cold.repartition("blk", "node").select("blk", "fp", "bits", "p", "q").mapInArrow(frugal(_walk), "a long, b long")
    limit = max(HOT_NODES, classes.count() * len(BLOCKS) // 65_536)
    width = F.expr("CASE WHEN blk = 0 THEN 22 ELSE 21 END")
    hot = sizes.filter(F.col("n") > limit).withColumn("bits", F.least(F.lit(64) - width, F.ceil(F.log2(F.col("n") / limit)).cast("int") + 2))
    all_ = dealt.join(F.broadcast(hot.drop("n")), ["blk", "node"], "left")  # at most 65,536 rows
    cold = all_.filter("bits IS NULL").select("blk", "node", "fp", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    at = all_.filter("bits IS NOT NULL").withColumn("w", width).withColumn("u", F.expr("shiftrightunsigned(rot, 64 - w - bits) & (shiftleft(1L, bits) - 1)"))
    # all sub-nodes at most BUDGET (two) bits away: none, one or two bits set
    near = F.expr("concat(array(0L), flatten(transform(sequence(0, bits - 1), i -> transform(sequence(i, bits - 1), j -> shiftleft(1L, i) | shiftleft(1L, j)))))")
    near = F.transform(near, lambda x: F.struct(F.least("u", F.col("u").bitwiseXOR(x)).alias("p"), F.greatest("u", F.col("u").bitwiseXOR(x)).alias("q")))
    deep = at.select("blk", "node", "fp", "bits", F.inline(near))
    return cold.unionByName(deep).repartition("blk", "node", "p", "q").select("blk", "fp", "bits", "p", "q").mapInArrow(frugal(_walk), "a long, b long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable by links of two bits or fewer."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = materialize(components(links(classes)))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(classes.drop("n").join(roots, classes.fp == roots.node).drop("node"))
    named = linked.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n"))
    named = attach(linked, named, "root", "n").select("fp", "component")
    label = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "rep").alias("component"))
    return attach(rows, materialize(label), "fp", "n").select(F.col("id").alias(id_col), "fp", "component")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the row with its smallest doc_id (rows with a null id stay).

    Where rows repeat an id, those that aren't the same in every column all stay.
    """
    per = materialize(dedup(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(OTHER)).agg(F.max("component").alias("c"), F.count(F.lit(1)).alias("n")))
    # by a sorted merge at any size: what is dropped grows with the table
    gone = per.filter(F.col("c") < F.col(OTHER)).select(OTHER).hint("merge")
    twice = per.filter("n > 1").select(OTHER).hint("merge")
    kept = docs.join(gone, docs["doc_id"] == gone[OTHER], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, kept["doc_id"] == twice[OTHER], "left_anti").unionByName(kept.join(twice, kept["doc_id"] == twice[OTHER], "left_semi").distinct())
    return kept.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
