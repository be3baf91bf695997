"""Language evidence and toxicity scores of whole tables, again by plain means."""

import math
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
from llm.conftest import SMALL

from radarlake.llm import op6_language as op6
from radarlake.llm import op9_toxicity as op9


def slow_grams(text):
    for w in re.findall(r"[^\W\d_]+", text):
        w = f" {w.lower()} "
        yield from (w[k : k + 3] for k in range(len(w) - 2))


def slow_fusion(rows, langs, logs, unknown):
    """Language and probability of rows (host, domain, suffix, declared, text), all evidence counted here."""
    k, ll, best = len(langs), [], []
    for *_, text in rows:
        s = np.zeros(k)
        for g in slow_grams(text):
            s += logs.get(g, unknown)
        ll.append(0.3 * (s - s.max()))
        best.append(langs[int(s.argmax())] if s.any() else None)
    at = {c: n for n, c in enumerate(langs)}
    known = [b for b in best if b]
    p0 = np.array([(known.count(c) + 1.0) / (len(known) + k) for c in langs])

    def counts(column):
        got = defaultdict(lambda: np.zeros(k))
        for r, b in zip(rows, best, strict=True):
            got[r[column]] += 0
            if b:
                got[r[column]][at[b]] += 1
        return got

    p1 = {d: (c + 10 * p0) / (c.sum() + 10) for d, c in counts(1).items()}
    above = {r[0]: r[1] for r in rows}
    prior = {h: (c + 10 * p1[above[h]]) / (c.sum() + 10) for h, c in counts(0).items()}

    def likelihood(column):
        got = {v: c for v, c in counts(column).items() if v is not None}
        total = sum(got.values(), np.zeros(k))
        return {v: np.log((c + 0.5) / (total + 0.5 * len(got) + 0.5)) for v, c in got.items()}

    said, suffix = likelihood(3), likelihood(2)
    out = []
    for r, x in zip(rows, ll, strict=True):
        s = x + np.log(prior[r[0]]) + said.get(r[3], np.zeros(k)) + suffix.get(r[2], np.zeros(k))
        p = np.exp(s - s.max())
        out.append((langs[int(s.argmax())], 1.0 / p.sum()))
    return out


def test_fusion_of_whole_tables_equals_brute_force(spark, documents):
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    langs, logs, unknown = op6.fit(docs)
    rows, names = [], []
    for d in documents:
        rows.append((f"s:{d['source'] or ''}", "documents", None, None, d["text"] or ""))
        names.append(("d", d["doc_id"]))
    for p in pages.collect():
        host = (urlsplit(p["url"]).hostname or "").lower()
        domain = ".".join(host.split(".")[-2:]) if "." in host else ""
        path = re.match(r"/([a-z]{2})(?:/|$)", urlsplit(p["url"]).path)
        said = re.search(r'<html[^>]*?\slang\s*=\s*["\']?([A-Za-z]{2,3})', p["html"], re.I)
        text = re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", p["html"], flags=re.S | re.I)
        rows.append((f"h:{host}", f"d:{domain}", f"/{path[1]}" if path else "." + host.split(".")[-1], said[1].lower() if said else None, text))
        names.append(("p", p["page_id"]))
    want = dict(zip(names, slow_fusion(rows, langs, logs, np.array(unknown)), strict=True))
    got = {("d", r["doc_id"]) if r["doc_id"] is not None else ("p", r["page_id"]): (r["language"], r["probability"]) for r in op6.query(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0] and math.isclose(got[key][1], want[key][1], abs_tol=2e-6), key


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = op6.fit(docs.filter("doc_id % 2 = 0"))
    truth = {r["doc_id"]: r["lang"] for r in docs.filter("doc_id % 2 = 1").collect()}
    got = {r["id"]: r["language"] for r in op6.fuse(op6.document_rows(docs.filter("doc_id % 2 = 1")), model).collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.97


def test_every_language_has_its_own_bound(spark, monkeypatch):
    """Many texts in one language take none of another's trigrams."""
    monkeypatch.setattr(op6, "MOST_GRAMS", 40)
    rows = [(k, f"the these there their then other another {k % 7}", "en") for k in range(300)] + [(900, "żółw łódź źdźbło", "pl")]
    langs, logs, _ = op6.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["en", "pl"] and {g for w in ("żółw", "łódź") for g in op6.grams(w)} <= set(logs)


def slow_isotonic(x, y):
    """Pools of equal or violating neighbours, until none violates."""
    mean = y.mean()
    pools = [[[v] * int((x == v).sum()), y[x == v].tolist()] for v in np.unique(x)]
    again = True
    while again:
        again = False
        for k in range(len(pools) - 1):
            if np.mean(pools[k][1]) >= np.mean(pools[k + 1][1]):
                pools[k : k + 2] = [[pools[k][0] + pools[k + 1][0], pools[k][1] + pools[k + 1][1]]]
                again = True
                break
    return [np.mean(p[0]) for p in pools], [(sum(p[1]) + mean) / (len(p[1]) + 1) for p in pools]


def test_scores_of_the_whole_table_equal_brute_force(spark, monkeypatch):
    """Dense cosines with all examples, votes and a plain isotonic fit, from the examples' ids and the vocabulary alone."""
    monkeypatch.setattr(op9, "CHI_SQUARE", 6.0)
    larger = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    ix = op9.fit(docs, labels)
    assert len(ix.ids) > 40
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}

    def terms(text):
        got = Counter()
        for w in re.findall(r"\w+", text.lower()):
            got.update(t for t in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)) if t in ix.vocab)
        return got

    df = Counter(t for text in texts.values() for t in terms(text))
    order = sorted(ix.vocab, key=ix.vocab.get)

    def vector(text):
        tf = terms(text)
        v = np.array([(1 + math.log(tf[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) if tf[t] else 0.0 for t in order])
        return v / np.sqrt((v * v).sum()) if v.any() else None

    ids = ix.ids.tolist()
    assert all(ix.label[k] == (truth[i] > 0) for k, i in enumerate(ids))
    examples = np.array([vector(texts[i]) for i in ids])

    def vote(cos):
        best = np.lexsort((np.arange(len(ids)), -np.round(cos, 12)))[:15]
        best = best[cos[best] > 0]
        w = cos[best] ** 2
        return ((w * ix.label[best]).sum() + 0.25 * ix.rest) / (w.sum() + 0.25) if len(best) else ix.rest

    cos = examples @ examples.T
    np.fill_diagonal(cos, -1)
    knots = slow_isotonic(np.array([vote(c) for c in cos]), ix.label) if len(ids) >= 40 else ([0.0, 1.0], [0.0, 1.0])
    got = {r["doc_id"]: r for r in op9.query(spark, larger).collect()}
    assert got.keys() == texts.keys()
    far = 0
    for i, text in texts.items():
        v = vector(text)
        want = ix.rest
        if v is not None and (examples @ v).max() > 0:
            raw = vote(examples @ v)
            want = min(max(0.95 * float(np.interp(raw, *knots)) + 0.05 * raw, 0.0), 1.0)
        # a tie at the fifteenth place may fall either way by rounding
        far += abs(got[i]["score"] - want) > 1e-6
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert far <= 0.01 * len(texts), far


def test_a_fit_can_be_repeated(spark):
    rows = [(k, t) for k in range(60) for t in (f"good calm text {k}", f"vile rotten text {k}")]
    lab = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    fits = [op9.fit(spark.createDataFrame(r, "doc_id long, text string"), lab) for r in (rows, rows[::-1])]
    assert fits[0].vocab == fits[1].vocab and fits[0].ids.tolist() == fits[1].ids.tolist() and np.allclose(fits[0].weight, fits[1].weight)
