"""Language ID by Bayesian evidence fusion.

Evidence of a row, each a likelihood of every language:

* text: naive Bayes over letter trigrams of words, fitted on a bounded sample of
  documents with a declared language (``FIT_ROWS``; of each language the ``MOST_GRAMS``
  most frequent trigrams), tempered as neighbouring trigrams repeat each other;
* the language that the markup declares (html lang) and the address suffix (a language
  code in the path, else the top-level domain), whose likelihoods are grouped counts
  against the text's best guess over all rows, smoothed;
* the host (for documents, the source) as a prior, smoothed towards its domain and that
  towards all rows: grouped counts again, so a hot host is only a sum.

The query takes both tables that hold text: ``pages`` with all evidence, and
``documents``, which declare nothing in markup and have a source for a host. A
document's lang column only serves to fit, never as evidence.

Edge cases: null or empty texts leave the other evidence to decide; null hosts, urls
and languages are missing evidence; without any fitted document the language is null;
repeated rows are judged alike; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from radarlake.llm.common import attach, frugal, materialize, workers_can_import
from radarlake.llm.op4_wrappers import host

FIT_ROWS = 8_192
MOST_GRAMS = 65_536
TEMPER = 0.3
#: Weight of the level above when a host's or domain's counts are smoothed.
SMOOTH = 10.0
WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
LANG = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)"


def grams(word: str) -> list[str]:
    w = f" {word.lower()} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(languages, log likelihoods of trigrams, those of an unknown one)."""
    workers_can_import(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    ids = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id").distinct()
    sample = docs.join(F.broadcast(ids), docs[id_col] == ids["id"], "left_semi").select(text_col, lang_col).filter(F.col(lang_col).isNotNull())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall(text or ""))
                for w, n in words.items():
                    for g in grams(w):
                        got[lang, g] += n.bit_length()  # a repeated line is not that much evidence
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(frugal(tally), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each language has its own bound, so none takes another's place
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", best).filter(F.col("place") <= MOST_GRAMS).collect()
    langs = sorted({r["lang"] for r in rows})
    total = dict.fromkeys(langs, 0)
    table: dict[str, dict[str, int]] = {}
    for r in rows:
        table.setdefault(r["gram"], {})[r["lang"]] = r["n"]
        total[r["lang"]] += r["n"]
    size = len(table) + 1
    logs = {g: [math.log((x.get(c, 0) + 0.5) / (total[c] + 0.5 * size)) for c in langs] for g, x in table.items()}
    return langs, logs, [math.log(0.5 / (total[c] + 0.5 * size)) for c in langs]


class WordScores:
    """Log likelihoods of words, each worked out once and kept in a matrix of bounded size."""

    def __init__(self, logs: dict[str, list[float]], unknown: list[float], most: int = 200_000):
        self.gram = {g: k + 1 for k, g in enumerate(logs)}
        self.table = np.array([unknown, *logs.values()]).reshape(len(logs) + 1, len(unknown))
        self.most, self.place, self.rows = most, {}, np.zeros((most, len(unknown)))

    def known(self, texts: list[list[str]]) -> list[list[str]]:
        """The texts, once all their words are in the matrix."""
        new = {w for t in texts for w in t if w not in self.place}
        if len(self.place) + len(new) > self.most:
            self.place.clear()
            new = {w for t in texts for w in t}
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]))
        new = sorted(new)
        grams_of = [[self.gram.get(g, 0) for x in WORD.findall(w) for g in grams(x)] for w in new]
        full = [k for k, g in enumerate(grams_of) if g]
        got = np.zeros((len(new), self.rows.shape[1]))
        if full:
            sizes = np.array([len(grams_of[k]) for k in full])
            flat = np.fromiter((g for k in full for g in grams_of[k]), dtype=np.int64, count=int(sizes.sum()))
            got[full] = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0)
        at = len(self.place)
        self.rows[at : at + len(new)] = got
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        return texts

    def total(self, words: list[str]) -> np.ndarray:
        place = self.place
        return self.rows[np.fromiter((place[w] for w in words), dtype=np.int64, count=len(words))].sum(axis=0)


def evidence(rows: DataFrame, model) -> DataFrame:
    """rows (table, id, host, domain, suffix, declared, text) -> the text replaced by ll and best."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MOST_GRAMS rows for each of the sample's languages
    kept = [c for c in rows.columns if c not in ("text", "markup")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, unknown = shared.value
        words = WordScores(logs, unknown)
        for b in batches:
            texts = [(MARKUP.sub(" ", t) if m else t).split() if t else [] for t, m in zip(b.column("text").to_pylist(), b.column("markup").to_pylist(), strict=True)]
            ll, best = [], []
            for text in words.known(texts):
                s = words.total(text)
                s = TEMPER * (s - s.max()) if langs else s
                ll.append(s.tolist())
                best.append(langs[int(s.argmax())] if langs and s.any() else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ll, pa.list_(pa.float64())), pa.array(best, pa.string())], names=[*kept, "ll", "best"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(frugal(run), f"{fields}, ll array<double>, best string")


def fuse(rows: DataFrame, model) -> DataFrame:
    """(table, id, language, probability, text_language, declared, suffix)"""
    workers_can_import(rows.sparkSession)
    langs = model[0]
    if not langs:
        return rows.select("table", "id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), "declared", "suffix")
    seen = materialize(evidence(rows, model))
    k = len(langs)
    per = [F.sum(F.when(F.col("best") == c, 1.0).otherwise(0.0)) for c in langs]
    overall = F.array(*(((s + 1.0) / (F.count("best") + float(k))) for s in per))
    everywhere = seen.agg(overall.alias("p0"))

    def smoothed(df: DataFrame, by: list[str], above: str, name: str) -> DataFrame:
        got = df.groupBy(*by, above).agg(F.array(*per).alias("c"), F.count("best").alias("m"), F.count(F.lit(1)).alias("n"))
        return got.select(*by, "n", F.zip_with("c", above, lambda c, p: (c + SMOOTH * p) / (F.col("m") + SMOOTH)).alias(name))

    def likelihood(column: str, name: str) -> DataFrame:
        """log P(value | language), smoothed, from counts against the text's best guess."""
        got = seen.filter(F.col(column).isNotNull()).groupBy(column).agg(F.array(*per).alias("c"), F.count(F.lit(1)).alias("n"))
        sums = got.agg(F.array(*(F.sum(F.col("c")[j]) for j in range(k))).alias("s"), F.count(F.lit(1)).alias("v"))
        got = got.crossJoin(F.broadcast(sums))  # one row
        return got.select(F.col(column), "n", F.zip_with("c", "s", lambda c, s: F.log((c + 0.5) / (s + 0.5 * F.col("v") + 0.5))).alias(name))

    domains = materialize(smoothed(seen.crossJoin(F.broadcast(everywhere)), ["domain"], "p0", "p1"))
    by_domain = attach(seen, domains, "domain", "n")
    hosts = materialize(smoothed(by_domain, ["host"], "p1", "prior"))
    got = attach(seen, hosts, "host", "n")
    for column, name in (("declared", "l1"), ("suffix", "l2")):
        table = materialize(likelihood(column, name))
        got = materialize(got)
        got = attach(got.filter(F.col(column).isNotNull()), table, column, "n").unionByName(got.filter(F.col(column).isNull()).withColumn(name, F.array_repeat(F.lit(0.0), k)))
    total = F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with("l1", "l2", lambda a, b: a + b), lambda a, b: a + b)
    got = got.withColumn("s", total).withColumn("top", F.array_max("s"))
    norm = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.element_at(F.array(*map(F.lit, langs)), F.array_position("s", F.col("top")).cast("int"))
    return got.select("table", "id", name.alias("language"), (1.0 / norm).alias("probability"), F.col("best").alias("text_language"), "declared", "suffix")


def page_rows(pages: DataFrame) -> DataFrame:
    at = host("url")
    none = F.lit(None).cast("string")
    path = F.regexp_extract("url", PATH, 1)
    tld = F.regexp_extract(at, r"\.([a-z]+)$", 1)
    said = F.lower(F.regexp_extract("html", LANG, 1))
    suffix = F.when(path != "", F.concat(F.lit("/"), path)).when(tld != "", F.concat(F.lit("."), tld))
    return pages.select(F.lit("pages").alias("table"), F.col("page_id").alias("id"), F.concat(F.lit("h:"), F.coalesce(at, F.lit(""))).alias("host"), F.concat(F.lit("d:"), F.coalesce(F.regexp_extract(at, r"([^.]+\.[^.]+)$", 1), F.lit(""))).alias("domain"), F.coalesce(suffix, none).alias("suffix"), F.when(said != "", said).alias("declared"), F.col("html").alias("text"), F.lit(True).alias("markup"))


def document_rows(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), F.concat(F.lit("s:"), F.coalesce("source", F.lit(""))).alias("host"), F.lit("documents").alias("domain"), none.alias("suffix"), none.alias("declared"), "text", F.lit(False).alias("markup"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    got = fuse(document_rows(docs).unionByName(page_rows(pages)), fit(docs))
    return got.select(F.when(F.col("table") == "documents", F.col("id")).alias("doc_id"), F.when(F.col("table") == "pages", F.col("id")).alias("page_id"), "language", F.round("probability", 6).alias("probability"), "text_language", "declared", "suffix")
