"""Benchmark decontamination by greedy string tiling.

Words are ``\\w+`` in lower case. The hashes of all 5-word seeds of the benchmark are
joined to each text's rolling (Karp-Rabin) hashes; a text with a shared seed is tiled
against each item that has one: the longest common run of unmarked words is found by
Karp-Rabin hashes of falling length and marked in both, again and again, until no run
of five words is left. Tiles may lie in any order, so reordered passages count. An item
leaks if its tiles cover 0.8 or more of its words.

Hashes are polynomials modulo 2^64 whose prefix sums are kept, so those of any length
cost one step a word. A tile is made of shared seeds, so only a text's words under seeds
of the item are tiled, and the work for a pair grows with what the two share.

The benchmark goes to the tasks in chunks of a bounded number of words. Chunks are
searched one after the other, each pass written before the next chunk goes out, so the
driver, the broadcast and the workers hold one chunk at a time.

Edge cases: null or empty texts and items share nothing; items under five words are
found only as one whole run; null ids are kept; repeated rows give repeated results;
empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from radarlake.llm.common import Memo, discard, frugal, materialize, workers_can_import

SEED_WORDS = 5
COVERAGE = 0.8
#: Words of the benchmark in one broadcast (about 40 MB in a Python worker).
CHUNK_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Rolling:
    """Karp-Rabin hashes of all runs of any number of words, modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.power = words, np.r_[np.uint64(1), np.cumprod(np.full(n, BASE))]
        self.sums = np.r_[np.uint64(0), np.cumsum(words * np.r_[np.uint64(1), np.cumprod(np.full(n, UNBASE))][:n])]

    def __call__(self, n: int) -> np.ndarray:
        m = len(self.words) - n + 1
        if m <= 0:
            return np.array([], dtype=np.uint64)
        h = (self.sums[n : n + m] - self.sums[:m]) * self.power[n - 1 : n - 1 + m]
        return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    return Rolling(words)(n)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n words none of which is marked."""
    ahead = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(ahead[n:] == ahead[:-n]) if len(marked) >= n else np.array([], dtype=np.int64)


def _seeded(text: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Places of the text's words that lie under seeds of the item."""
    mark = np.zeros(len(text) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(rolling(text, least), rolling(item, least)))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + least, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes: (start in text, start in item, length), longest first."""
    if len(text) < least or len(item) < least:
        return []
    where = _seeded(text, item, least)
    gap = np.r_[False, np.diff(where) > 1]
    # stretches that don't meet in the text are kept apart by a marked word
    place = np.arange(len(where)) + np.cumsum(gap)
    words = np.zeros(len(where) + int(gap.sum()), dtype=np.uint64)
    words[place] = text[where]
    used_t, used_i = np.ones(len(words), dtype=bool), np.zeros(len(item), dtype=bool)
    used_t[place] = False
    back = np.zeros(len(words), dtype=np.int64)
    back[place] = where
    roll_t, roll_i = Rolling(words), Rolling(item)
    out: list[tuple[int, int, int]] = []
    n = _next(roll_t, roll_i, used_t, used_i, len(item) + 1, least)
    while n >= least:
        ft, fi = _free(used_t, n), _free(used_i, n)
        ht, hi = roll_t(n)[ft], roll_i(n)[fi]
        hit = np.flatnonzero(np.isin(ht, hi))
        spots: dict[int, list[int]] = {}
        for k in np.flatnonzero(np.isin(hi, ht[hit])).tolist():
            spots.setdefault(int(hi[k]), []).append(int(fi[k]))
        for k in hit.tolist():
            s = int(ft[k])
            if used_t[s : s + n].any():
                continue
            for j in spots[int(ht[k])]:
                if not used_i[j : j + n].any() and (words[s : s + n] == item[j : j + n]).all():
                    used_t[s : s + n] = used_i[j : j + n] = True
                    out.append((int(back[s]), j, n))
                    break
        n = _next(roll_t, roll_i, used_t, used_i, n, least)
    return out


def _next(text: Rolling, item: Rolling, used_t, used_i, n: int, least: int) -> int:
    """The longest length under n at which unmarked runs have an equal hash, by bisection, or least - 1."""

    def shared(m: int) -> bool:
        return bool(np.isin(item(m)[_free(used_i, m)], text(m)[_free(used_t, m)]).any())

    lo, hi = least - 1, min(n - 1, len(text.words), len(item.words))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if shared(mid) else (lo, mid - 1)
    return lo


class Chunk:
    """Items with the sorted hashes of their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        import xxhash

        self.memo = Memo(xxhash.xxh64_intdigest)
        self.items = [(i, self.hashes(w)) for i, w in items if w]
        seeds = [(n, rolling(h, n)) for _, h in self.items for n in [min(SEED_WORDS, len(h))]]
        self.short = sorted({n for n, _ in seeds if n < SEED_WORDS})
        at = np.concatenate([np.full(len(s), k) for k, (_, s) in enumerate(seeds)]) if seeds else np.array([], dtype=np.int64)
        size = np.concatenate([np.full(len(s), n) for n, s in seeds]) if seeds else np.array([], dtype=np.int64)
        seed = np.concatenate([s for _, s in seeds]) if seeds else np.array([], dtype=np.uint64)
        self.by = {}
        for n in {SEED_WORDS, *self.short}:
            here = size == n
            order = np.argsort(seed[here], kind="stable")
            self.by[n] = seed[here][order], at[here][order]
        #: One bit for each value of 20 bits: most places of a text end here.
        self.maybe = {n: np.zeros(1 << 20, dtype=bool) for n in self.by}
        for n, (s, _) in self.by.items():
            self.maybe[n][(s >> np.uint64(44)).astype(np.int64)] = True

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.memo[w] for w in words), dtype=np.uint64, count=len(words))

    def search(self, text: str | None) -> Iterator[tuple[int, float, int, int, int, int]]:
        """(item, coverage, tiles, matched words, longest, first word) of the items that share a seed."""
        h = self.hashes(words_of(text))
        rolled, found = Rolling(h), set()
        for n, (seed, at) in self.by.items():
            roll = rolled(n)
            roll = roll[self.maybe[n][(roll >> np.uint64(44)).astype(np.int64)]]
            if len(roll) and len(seed):
                lo, hi = np.searchsorted(seed, roll, "left"), np.searchsorted(seed, roll, "right")
                for a, b in {(int(a), int(b)) for a, b in zip(lo, hi, strict=True) if b > a}:
                    found.update(at[a:b].tolist())
        for k in sorted(found):
            item, own = self.items[k]
            got = tiles(h, own, min(SEED_WORDS, len(own)))
            if got:
                words = sum(n for _, _, n in got)
                yield item, words / len(own), len(got), words, got[0][2], min(s for s, _, _ in got)


def chunks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark's items in chunks of at most CHUNK_WORDS words (one item may be longer)."""
    part, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        w = words_of(r[1])
        if part and size + len(w) > CHUNK_WORDS:
            yield part
            part, size = [], 0
        part.append((r[0], w))
        size += len(w)
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words, longest, first_word) where the coverage is reached."""
    spark = docs.sparkSession
    workers_can_import(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    kinds = src.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles int, n_words int, longest int, first_word int"

    def search(part):
        items = spark.sparkContext.broadcast(part)

        def run(batches):
            chunk = Chunk(items.value)
            for b in batches:
                rows, out = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    got = [x for x in chunk.search(t) if x[1] >= coverage - 1e-12]
                    rows += [k] * len(got)
                    out += got
                cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((None, pa.float64(), *(pa.int32(),) * 4)) if k]
                item = pa.array([x[0] for x in out], item_kind)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), item, *cols], names=["doc_id", "item_id", "coverage", "n_tiles", "n_words", "longest", "first_word"])

        return src.mapInArrow(frugal(run), schema), items

    found = []
    for part, last in _ends(chunks(benchmark, item_col, "text")):
        got, items = search(part)
        if not last:
            got = materialize(got)
            items.destroy()
        found.append(got)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _ends(parts: Iterator) -> Iterator[tuple]:
    """(part, whether it is the last)"""
    held: list = []
    for part in parts:
        if held:
            yield held.pop(), False
        held.append(part)
    if held:
        yield held.pop(), True


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a leaked item, in all their columns; no row is shuffled."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    at, out = docs.columns.index("text"), docs
    workers_can_import(spark)
    for part, last in _ends(chunks(bench, "item_id", "text")):
        items = spark.sparkContext.broadcast(part)

        def run(batches, items=items):
            chunk = Chunk(items.value)
            for b in batches:
                yield b.filter(pa.array([not any(x[1] >= COVERAGE - 1e-12 for x in chunk.search(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        before, out = out, out.mapInArrow(frugal(run), docs.schema)
        if not last:
            out = materialize(out)
            items.destroy()
            if before is not docs:
                discard(before)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    got = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.withColumn("coverage", F.round("coverage", 6))
