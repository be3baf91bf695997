"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fit. At most ``fit_rows`` labelled rows (a documented bound, picked by a hash of the
id; rows whose crc32 mod 4 is 2 never) give the examples; near copies among them count
once. Terms are words and word beginnings of 4 to 6 letters; those that depend on the
label beyond chance (chi-square) are the vocabulary. Document frequencies are counted
over all documents. The examples form a block-max inverted index: per term its
postings, cut into blocks of examples, each with its largest weight.

Score. A text's blocks are visited by falling upper bound until none can beat the k-th
best cosine, so the k nearest are exact. Their votes, weighted by squared cosine, are
mapped to a probability by an isotonic fit on leave-one-out votes of the examples. The
nearest examples come back as evidence. Texts without any term get the label's rate
among examples without any.

Edge cases: null or empty texts have no terms; a null id counts as not held out and
never as labelled; an id with several labels takes the largest, one with several texts
gives the least of them as an example; null labels are unlabelled; without any example every score is 0; repeated rows are scored alike; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import Memo, frugal, materialize, workers_can_import

FIT_ROWS = 16_384
CHI_SQUARE = 30.0
LEAST_DF = 3
NEIGHBOURS = 15
BLOCK = 64
#: Jaccard similarity of the 5-word shingles of near copies.
NEAR = 0.8
PRIOR_WEIGHT = 0.25
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(token: str) -> tuple[str, ...]:
    """A token's words and their beginnings (marked by a star)."""
    out = []
    for w in WORD.findall(token):
        out.append(w)
        out += [w[:n] + "*" for n in (4, 5, 6) if len(w) >= n]
    return tuple(out)


class Index(NamedTuple):
    """Examples by term, cut into blocks. Arrays are parallel to the postings."""

    vocab: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of examples
    label: np.ndarray
    start: np.ndarray  # of a term's postings
    doc: np.ndarray
    weight: np.ndarray
    bstart: np.ndarray  # of a term's blocks
    block: np.ndarray
    bmax: np.ndarray
    bfrom: np.ndarray  # a block's postings
    bto: np.ndarray
    rest: float  # the label's rate among examples without a term
    knots: tuple[np.ndarray, np.ndarray]


def weigh(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[at]
    return w / np.sqrt((w * w).sum())


def build(vocab: dict[str, int], idf: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]]) -> Index:
    """rows: (id, label, terms, counts) of the examples."""
    without = [y for _, y, at, _ in rows if not len(at)]
    rate = (sum(y for _, y, _, _ in rows) + 0.5) / (len(rows) + 1) if rows else 0.0
    rest = (sum(without) + rate) / (len(without) + 1) if rows else 0.0
    full = [(i, y, np.array(at), np.array(tf)) for i, y, at, tf in rows if len(at)]
    vecs = [weigh(at, tf, idf) for _, _, at, tf in full]
    order = sorted(range(len(full)), key=lambda k: (int(full[k][2][vecs[k].argmax()]), -float(vecs[k].max()), full[k][0]))
    post = sorted((int(t), d, float(w)) for d, k in enumerate(order) for t, w in zip(full[k][2], vecs[k], strict=True))
    term = np.array([p[0] for p in post], dtype=np.int64)
    doc = np.array([p[1] for p in post], dtype=np.int64)
    weight = np.array([p[2] for p in post])
    edges = np.arange(len(vocab) + 1)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)]) if len(post) else np.array([], dtype=np.int64)
    bmax = np.maximum.reduceat(weight, first) if len(post) else np.array([])
    out = Index(vocab, idf, np.array([full[k][0] for k in order], dtype=np.int64), np.array([full[k][1] for k in order], dtype=np.float64), np.searchsorted(term, edges), doc, weight, np.searchsorted(term[first], edges), doc[first] // BLOCK, bmax, first, np.r_[first[1:], len(post)], rest, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    if len(full) < 40:
        return out
    raw = np.array([vote(out, *nearest(out, full[k][2], vecs[k], but=d))[0] for d, k in enumerate(order)])
    return out._replace(knots=isotonic(raw, out.label))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit (pool adjacent violators), each mean shrunk a little to the overall one."""
    mean, pools = float(y.mean()), []
    for v in np.unique(x):
        here = y[x == v]
        pools.append([float(v) * len(here), float(here.sum()), len(here)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + mean) / (p[2] + 1) for p in pools])


def nearest(ix: Index, at: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The examples of the k highest cosines (ties: index order) and these, exactly; ``but`` is left out."""
    if not len(ix.ids):
        return np.array([], dtype=np.int64), np.array([])
    bound = np.zeros(len(ix.ids) // BLOCK + 1)
    for t, q in zip(at, w, strict=True):
        here = slice(ix.bstart[t], ix.bstart[t + 1])
        bound[ix.block[here]] += q * ix.bmax[here]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    docs, scores, kth, k, step = np.array([], dtype=np.int64), np.array([]), 0.0, 0, 4
    while k < len(order) and (len(docs) < NEIGHBOURS or bound[order[k]] > kth + 1e-12):
        now = order[k : k + step]
        k, step = k + step, step * 2
        near = np.zeros((len(now), BLOCK))
        place = np.full(len(bound), -1)
        place[now] = np.arange(len(now))
        for t, q in zip(at, w, strict=True):
            s, e = ix.bstart[t], ix.bstart[t + 1]
            for b in np.flatnonzero(place[ix.block[s:e]] >= 0) + s:
                p = slice(ix.bfrom[b], ix.bto[b])
                near[place[ix.block[b]], ix.doc[p] % BLOCK] += q * ix.weight[p]
        r, c = np.nonzero(near)
        docs, scores = np.r_[docs, now[r] * BLOCK + c], np.r_[scores, near[r, c]]
        docs, scores = docs[docs != but], scores[docs != but]
        best = np.lexsort((docs, -scores))[:NEIGHBOURS]
        docs, scores = docs[best], scores[best]
        kth = scores[-1] if len(scores) == NEIGHBOURS else 0.0
    return docs, scores


def vote(ix: Index, docs: np.ndarray, cos: np.ndarray) -> tuple[float, float]:
    """The weighted vote and its probability."""
    w = cos * cos
    raw = float(((w * ix.label[docs]).sum() + PRIOR_WEIGHT * ix.rest) / (w.sum() + PRIOR_WEIGHT)) if len(docs) else ix.rest
    return raw, 0.95 * float(np.interp(raw, *ix.knots)) + 0.05 * raw


class Scorer:
    """Texts to sparse counts, and these to scores."""

    def __init__(self, vocab: dict[str, int], ix: Index | None = None):
        self.ix = ix
        #: How terms begin: a token of one word that begins otherwise has none.
        self.heads = frozenset(t.rstrip("*")[:4] for t in vocab)
        self.memo = Memo(lambda token: tuple(vocab[x] for x in terms(token) if x in vocab))
        self.known = Memo(self._score, 100_000)

    def counts(self, text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        got: dict[int, int] = {}
        heads, memo = self.heads, self.memo
        for token in [t for t in (text or "").lower().split() if t[:4] in heads or not t.isalnum()]:
            for t in memo[token]:
                got[t] = got.get(t, 0) + 1
        at = sorted(got)
        return tuple(at), tuple(got[t] for t in at)

    def _score(self, key) -> tuple[float, list]:
        at, tf = key
        if not at:
            return self.ix.rest, []
        at = np.array(at)
        docs, cos = nearest(self.ix, at, weigh(at, np.array(tf), self.ix.idf))
        if not len(docs):
            return self.ix.rest, []
        _, p = vote(self.ix, docs, cos)
        return min(max(p, 0.0), 1.0), [(int(self.ix.ids[d]), float(c), int(self.ix.label[d])) for d, c in zip(docs[:3], cos[:3], strict=True)]

    def score(self, text: str | None) -> tuple[float, list]:
        return self.known[self.counts(text)]


def _unlike(table: pa.Table) -> pa.Table:
    """Of examples with one label and one equal min-hash, those that are no near copy of an earlier kept one."""
    table = table.sort_by("doc_id")
    shingles = table.column("shingles").combine_chunks()
    sizes = np.diff(shingles.offsets.to_numpy())
    flat, owner = shingles.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    kept, cuts = np.zeros(len(sizes), dtype=bool), np.cumsum(sizes) - sizes
    own = np.empty(len(order), dtype=np.int64)  # places in flat, text by text
    own[order] = np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.r_[True, flat[1:] != flat[:-1]], np.arange(len(flat)), 0))
    for k, n in enumerate(sizes):
        at = own[cuts[k] : cuts[k] + n]
        # earlier texts that have a shingle stand between its first place and this text's
        shared = np.bincount(np.concatenate([owner[first[x] : x] for x in at]), minlength=k)[:k]
        kept[k] = not (kept[:k] & (shared >= NEAR * (n + sizes[:k] - shared) - 1e-9)).any()
    return table.filter(pa.array(kept))


def _min_shingles(text: str) -> tuple[int, int, list[int]]:
    """Two min-hashes of the 5-word shingles, by which near copies among the examples are looked up, and the shingles."""
    import xxhash

    words = text.lower().split()
    got = [xxhash.xxh64_intdigest(" ".join(x)) for x in zip(*(words[k:] for k in range(5)), strict=False)] or [xxhash.xxh64_intdigest(" ".join(words))]
    h = np.array(got, dtype=np.uint64)
    one, two = int(h.min()), int((h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))).min())
    return one - (1 << 63), two - (1 << 63), np.unique(h).view(np.int64).tolist()


def _chi_square(n1, n0, all1: int, all0: int):
    """Of a term found in n1 of all1 toxic and n0 of all0 other examples, Yates-corrected."""
    n = all1 + all0
    d = F.greatest(F.abs(n1 * F.lit(float(all0)) - n0 * F.lit(float(all1))) - n / 2.0, F.lit(0.0))
    return d * d * n / ((n1 + n0) * F.greatest(F.lit(float(n)) - n1 - n0, F.lit(0.5)) * float(max(all1, 1)) * float(max(all0, 1)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Index:
    """docs (doc_id, text); labels (doc_id, toxic). What reaches the driver is bounded by fit_rows: the sample's terms and vectors."""
    spark = docs.sparkSession
    workers_can_import(spark)
    docs = docs.select("doc_id", "text")
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("y"))

    def keyed(batches):
        for b in batches:
            m = [_min_shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in m], pa.int64()), pa.array([x[1] for x in m], pa.int64()), pa.array([x[2] for x in m], pa.list_(pa.int64()))], names=["doc_id", "text", "y", "m1", "m2", "shingles"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    sample = materialize(sample.mapInArrow(frugal(keyed), f"doc_id {kind}, text string, y int, m1 long, m2 long, shingles array<long>"))
    ids = sample.select("doc_id", "y", "m1", "m2", "shingles")
    for m in ("m1", "m2"):
        many = F.broadcast(ids.groupBy("y", m).count().filter("count > 1").select("y", m))  # at most fit_rows / 2
        alike = ids.join(many, ["y", m], "left_semi").groupBy("y", m).applyInArrow(_unlike, ids.schema)
        ids = materialize(ids.join(many, ["y", m], "left_anti").select(*ids.columns).unionByName(alike))
    one = ids.select("doc_id").distinct()  # at most fit_rows
    sample = sample.select("doc_id", "text", "y").join(F.broadcast(one), "doc_id")
    # of rows that repeat an id, the least text, so that a fit can be repeated
    sample = materialize(sample.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("x")).select("doc_id", "x.text", "x.y"))
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    all1, all0 = size.get(1, 0), size.get(0, 0)

    def tally(batches):
        memo, got = Memo(terms), Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([y for _, y in got], pa.int32()), pa.array(list(got.values()), pa.int64())], names=["term", "y", "n"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.update((x, y) for x in {x for t in set(text.lower().split()) for x in memo[t]})
                if len(got) > 300_000:
                    yield flush()
                    got.clear()
        yield flush()

    found = sample.select("text", "y").mapInArrow(frugal(tally), "term string, y int, n long").groupBy("term").agg(F.sum(F.expr("CASE WHEN y = 1 THEN n ELSE 0 END")).alias("n1"), F.sum(F.expr("CASE WHEN y = 0 THEN n ELSE 0 END")).alias("n0"))
    best = found.filter(F.col("n1") + F.col("n0") >= LEAST_DF).withColumn("x", _chi_square(F.col("n1"), F.col("n0"), all1, all0)).filter(F.col("x") >= CHI_SQUARE)
    vocab = {r["term"]: k for k, r in enumerate(best.orderBy(F.desc("x"), "term").select("term").collect())}  # of the sample's words

    def df_counts(batches):
        scorer, got, n = Scorer(vocab), Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                got.update(scorer.counts(text)[0])
                n += 1
        got[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.int64())], names=["t", "n"])

    df = dict(docs.select("text").mapInArrow(frugal(df_counts), "t int, n long").groupBy("t").agg(F.sum("n")).collect())  # the vocabulary's counts
    n = df.get(-1, 0)
    idf = np.array([math.log((1 + n) / (1 + df.get(k, 0))) + 1 for k in range(len(vocab))])

    def vectors(batches):
        scorer = Scorer(vocab)
        for b in batches:
            got = [scorer.counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.int32()))], names=["doc_id", "y", "at", "tf"])

    rows = sample.mapInArrow(frugal(vectors), f"doc_id {kind}, y int, at array<int>, tf array<int>").collect()  # at most fit_rows
    return build(vocab, idf, sorted((tuple(r) for r in rows), key=lambda r: r[0]))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence is the three nearest examples."""
    spark = docs.sparkSession
    workers_can_import(spark)
    shared = spark.sparkContext.broadcast(index)  # bounded by FIT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.vocab, shared.value)
        proof = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            got = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in got], pa.float64()), pa.array([int(x[0] >= THRESHOLD) for x in got], pa.int32()), pa.array([[dict(zip(("doc_id", "cosine", "toxic"), e, strict=True)) for e in x[1]] for x in got], proof)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, in all their columns; no row is moved."""
    index = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index.value.vocab, index.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t)[0] < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
