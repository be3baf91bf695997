"""License scans by a positional rare-token index, in DataFrame functions only.

Text is lower-cased (A-Z) and reduced to its words, each between single spaces, so a
phrase is a substring. The base labels come from such phrases. The method: words of
licence templates (without stop words) are the index terms, their IDF counted over all
documents. The places of all of a document's licence words are joined to the
templates' postings; places with an equal difference (place in document minus place in
template) belong to one reading of the template, in which rare words weigh most. A
template is found where half of the weight of its terms, and two terms or more, line up,
and its key phrase is there. The score is the best weight share of a found template, 0.5
at least with a base label. All of a document's licence words count, however many.

Texts are read once: what is written of them are counts, labels and the places of
licence words, and all that follows reads that.

Edge cases: null and empty texts have no words (0 counts, empty labels, score 0); null
ids are kept; repeated rows are judged alike and all stay; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices by which licences are applied, and their key phrases.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "as is basis"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
)
STOP = frozenset("a an and any are as by can for is in it of on or that the this to under use with without you".split()) | frozenset("0 2 3 4 v".split())
POSTINGS = tuple((t, w, p) for t, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split()) if w not in STOP)
VOCABULARY = tuple(sorted({w for _, w, _ in POSTINGS}))
KEYS = tuple(dict.fromkeys(key for _, _, key in TEMPLATES))


def _spaces(col):
    return F.length(col) - F.length(F.translate(col, " ", ""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))
    src = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), body, F.lit(" ")).alias("s"))
    words = F.when(F.length("s") > 2, _spaces(F.col("s")) - 1).otherwise(0)
    has = {p: F.contains("s", F.lit(f" {p} ")) for p, _ in BASE}
    pieces = {p: F.split("s", f" {p}(?= )") for p, _ in BASE}
    base = src.select(
        "id", words.cast("long").alias("n_words"), "s",
        *(F.when(has[p], pieces[p]).alias(f"p{k}") for k, (p, _) in enumerate(BASE)),
        F.split(F.trim("s"), " ").alias("words"),
    )
    firsts = [_spaces(F.element_at(f"p{k}", 1)) for k in range(len(BASE))]
    lasts = [F.col("n_words") - (_spaces(F.element_at(f"p{k}", -1)) - 1) - len(p.split()) for k, (p, _) in enumerate(BASE)]
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"p{k}").isNotNull(), F.lit(x)) for k, (_, x) in enumerate(BASE)))))
    keys = sum(F.when(F.contains("s", F.lit(f" {key} ")), F.lit(1 << k)).otherwise(0) for k, key in enumerate(KEYS))
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    hits = F.filter(F.transform("words", lambda w, k: F.when(w.isin(*VOCABULARY), F.struct(k.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    rows = materialize(base.select(
        "id", F.monotonically_increasing_id().alias("rid"), "n_words",
        sum(F.when(F.col(f"p{k}").isNotNull(), F.size(f"p{k}") - 1).otherwise(0) for k in range(len(BASE))).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        base_labels.alias("own"), keys.alias("keys"), F.when(F.arrays_overlap("words", vocabulary), hits).alias("hits"),
    ))
    n = rows.count()
    some = rows.filter("hits IS NOT NULL").select("rid", "keys", "hits")
    df = some.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    terms = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, '{w}', {p})" for t, w, p in POSTINGS) + " AS v(tpl, word, place)")
    terms = terms.join(F.broadcast(df), "word", "left").withColumn("idf", F.log((F.lit(1.0) + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)  # as many rows as POSTINGS
    spots = some.select("rid", "keys", F.inline("hits"))
    hits = spots.join(F.broadcast(terms.select("word", "tpl", "place", "idf")), "word")
    once = hits.groupBy("rid", "keys", "tpl", (F.col("at") - F.col("place")).alias("shift"), "word", "idf").agg(F.count(F.lit(1)).alias("c"))
    read = once.groupBy("rid", "keys", "tpl", "shift").agg(F.count("word").alias("k"), F.sum("idf").alias("w"))
    whole = terms.select("tpl", "word", "idf").distinct().groupBy("tpl").agg(F.sum("idf").alias("all_w"))
    names = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, '{label}', {1 << KEYS.index(key)})" for t, (label, _, key) in enumerate(TEMPLATES)) + " AS v(tpl, label, bit)")
    found = read.filter("k >= 2").join(F.broadcast(whole.join(names, "tpl")), "tpl").withColumn("share", F.least(F.col("w") / F.col("all_w"), F.lit(1.0))).filter("(keys & bit) = bit AND share >= 0.5")
    found = found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = rows.drop("hits", "keys").join(found, "rid", "left")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("own") > 0, F.lit(0.5)).otherwise(0.0))
    labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    def places(p: str) -> str:
        w = p.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w))
        return f"list_filter(range(len(w)), lambda i: {test})"

    values = lambda rows: ", ".join(rows)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT *, {', '.join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(BASE))}, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
postings(tpl, word, place) AS (VALUES {values(f"({t}, '{w}', {p})" for t, w, p in POSTINGS)}),
names(tpl, label, phrase) AS (VALUES {values(f"({t}, '{label}', '{key}')" for t, (label, _, key) in enumerate(TEMPLATES))}),
spots AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM b),
df AS (SELECT word, count(DISTINCT rid) AS df FROM spots WHERE word IN (SELECT word FROM postings) GROUP BY word),
terms AS (SELECT tpl, word, place, ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + coalesce(df, 0))) + 1e0 AS idf FROM postings LEFT JOIN df USING (word)),
hits AS (SELECT DISTINCT rid, tpl, pos - place AS shift, word, idf FROM spots JOIN terms USING (word)),
reading AS (SELECT rid, tpl, shift, count(*) AS k, sum(idf) AS w FROM hits GROUP BY ALL),
whole AS (SELECT tpl, sum(idf) AS all_w FROM (SELECT DISTINCT tpl, word, idf FROM terms) GROUP BY tpl),
found AS (SELECT rid, list(DISTINCT label) AS more, max(least(reading.w / all_w, 1e0)) AS share
          FROM reading JOIN whole USING (tpl) JOIN names USING (tpl) JOIN b USING (rid)
          WHERE k >= 2 AND least(reading.w / all_w, 1e0) >= 0.5e0 AND contains(b.s, ' ' || phrase || ' ') GROUP BY rid),
o AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, (_, x) in enumerate(BASE))}], lambda x: x IS NOT NULL)) AS own FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({' + '.join(f'len(p{k})' for k in range(len(BASE)))} AS BIGINT) AS n_base,
  CAST(least({', '.join(f'list_min(p{k})' for k in range(len(BASE)))}) AS BIGINT) AS first_word,
  CAST(greatest({', '.join(f'list_max(p{k})' for k in range(len(BASE)))}) AS BIGINT) AS last_word,
  array_to_string(own, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, CAST([] AS VARCHAR[]))))), ',') AS labels,
  round(greatest(coalesce(share, 0e0), CASE WHEN len(own) > 0 THEN 0.5e0 ELSE 0e0 END), 6) AS score
FROM o LEFT JOIN found USING (rid)
"""


SQL = _sql()
