"""Substring dedup, decontamination and the pipeline against brute force."""

import random

import numpy as np
import pytest
from llm.conftest import ODD, SMALL

import corpus_pipeline
from radarlake.llm import op1_decontaminate as op1
from radarlake.llm import op2_substrings as op2
from radarlake.llm import op3_bpe, op9_toxicity


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x{rng.randrange(9)}" for _ in range(n)]


# --- 2


def cartesian(h, lo, hi, span, out):
    """Compact windows by the definition: the least token splits the range."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < span:
            continue
        c = min(range(lo, hi), key=lambda k: (h[k] >> 22, k))
        out.add((lo, c, hi - 1))
        todo += [(lo, c), (c + 1, hi)]


@pytest.mark.parametrize("span", [1, 2, 5, 13])
def test_compact_windows(span):
    rng = random.Random(span)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 6))]
        h = [rng.choice((rng.getrandbits(64), 5 << 40, 7 << 50)) for _ in range(sum(sizes))]
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        want: set = set()
        for e, n in zip(ends, sizes, strict=True):
            cartesian(h, int(e - n), int(e), span, want)
        got = op2.compact_windows(np.array(h, dtype=np.uint64), doc, ends[doc], span)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def covers(found, doc, lo, hi):
    marked = set()
    for r in found:
        if r["id"] == doc:
            marked.update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return len(marked & set(range(lo, hi))) / (hi - lo)


def test_planted_passages(spark, frame):
    rng = random.Random(2)
    shared, other = words(rng, 60), words(rng, 55)
    near = list(shared)
    near[30] = "changed"
    docs, places = {}, {}
    for i in range(60):
        w = words(rng, rng.randint(60, 300))
        kind = i % 6
        if kind in (0, 1, 2):
            at = rng.randint(0, len(w))
            part = (shared, near, other)[kind]
            w[at:at] = part
            places[i] = (kind, at, at + len(part))
        docs[i] = " ".join(w)
    found = op2.find(frame(docs.items())).collect()
    flagged = {r["id"] for r in found}
    assert flagged <= set(places)
    first = {0: 0, 1: 0, 2: min(i for i in places if places[i][0] == 2)}
    for i, (kind, lo, hi) in places.items():
        if i != first[kind]:
            assert covers(found, i, lo, hi) >= 0.9, (i, kind)
    assert all(r["source"] < r["id"] for r in found)


def test_exact_copies_and_stars(spark, frame, monkeypatch):
    monkeypatch.setattr(op2, "STAR", 8)
    rng = random.Random(4)
    text = " ".join(words(rng, 120))
    docs = [(i, text) for i in range(40)] + [(40, " ".join(words(rng, 120)))]
    found = op2.find(frame(docs)).collect()
    assert {(r["id"], r["first_word"], r["n_words"], r["source"]) for r in found} == {(i, 0, 120, 0) for i in range(1, 40)}
    kept = op2.stage(spark, frame(docs), SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 40]


def test_cut_keeps_the_rest(spark, frame):
    rng = random.Random(6)
    passage, head, tail = words(rng, 70), words(rng, 30), words(rng, 20)
    docs = [(1, " ".join(passage)), (2, "  " + " ".join(head) + "\n" + " ".join(passage) + "\n\n" + " ".join(tail)), (3, "short"), (None, " ".join(passage)), (4, None)]
    kept = {r["doc_id"]: r for r in op2.stage(spark, frame(docs), SMALL).collect()}
    assert kept[2]["text"] == "  " + " ".join(head) + "\n" + " ".join(tail) and kept[2]["n_chars"] == len(kept[2]["text"])
    assert kept[1]["text"] == docs[0][1] and kept[3]["text"] == "short" and kept[None]["text"] == docs[3][1] and kept[4]["text"] is None
    assert op2.without("a b c d", [(1, 2)]) == "a d" and op2.without("a b", [(0, 9)]) == "" and op2.without("", [(0, 3)]) == ""


def test_substring_edge_cases(spark, frame):
    found = op2.find(frame(ODD)).collect()
    assert found == []
    assert op2.find(frame([])).count() == 0
    assert op2.stage(spark, frame([]), SMALL).count() == 0
    kept = op2.stage(spark, frame(ODD), SMALL)
    assert kept.count() == len(ODD) and kept.columns == frame([]).columns


def test_all_exact_repeats_are_found(spark, documents):
    seen: dict = {}
    need = set()
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        w = d["text"].lower().split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if seen.setdefault(key, d["doc_id"]) != d["doc_id"]:
                need.add(d["doc_id"])
    found = {r["doc_id"] for r in op2.query(spark, SMALL).collect()}
    assert need <= found


# --- 1


def slow_tiles(a, b, least):
    """Greedy string tiling by trying everything."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, at = n, [(i, j)]
                elif n == best and n >= least:
                    at.append((i, j))
        if not at:
            return out
        for i, j in at:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = [True] * best
                used_b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiling_equals_the_slow_one():
    rng = random.Random(1)
    for _ in range(150):
        a, b = [rng.randrange(4) for _ in range(rng.randint(0, 40))], [rng.randrange(4) for _ in range(rng.randint(1, 25))]
        got = op1.tiles(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 3)
        assert sorted(got) == sorted(slow_tiles(a, b, 3))


def test_rolling_hashes():
    """Any run's hash is that of its words alone."""
    rng = np.random.default_rng(5)
    w = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (1, 2, 5, 40, 300):
        h = op1.rolling(w, n)
        assert len(h) == 301 - n and all(op1.rolling(w[k : k + n].copy(), n)[0] == h[k] for k in range(0, len(h), 7))
    assert len(op1.rolling(w, 301)) == len(op1.rolling(w[:0], 1)) == 0


def test_very_long_texts_are_tiled():
    """A million words against an item of five thousand, in seconds."""
    import time

    rng = np.random.default_rng(6)
    item = rng.integers(0, 1 << 60, 5_000, dtype=np.uint64)
    text = rng.integers(0, 1 << 60, 1_000_000, dtype=np.uint64)
    text[1000:3500], text[700_000:702_400] = item[2500:], item[:2400]
    began = time.time()
    got = op1.tiles(text, item, 5)
    assert sorted(got) == [(1000, 2500, 2500), (700_000, 0, 2400)] and time.time() - began < 20
    same = op1.tiles(np.tile(item[:50], 2000), item, 5)
    assert same[0][1:] == (0, 50)


def test_string_item_ids(spark, frame):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("a", text), (None, text)], "item_id string, text string")
    assert sorted((r["doc_id"], r["item_id"] or "") for r in op1.leaks(frame([(1, text), (2, "no")]), bench).collect()) == [(1, ""), (1, "a")]
    assert op1.leaks(frame([(2, "no")]), bench).count() == 0


def test_chunks_pass_one_after_the_other(spark, frame, monkeypatch, tmp_path):
    rng = random.Random(18)
    items = [(k, " ".join(words(rng, 30)), "x") for k in range(9)]
    spark.createDataFrame(items, "item_id long, text string, lang string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, " ".join(words(rng, 40)) + (" " + items[i % 9][1] if i % 2 else "")) for i in range(30)]
    for size in (500_000, 50):
        monkeypatch.setattr(op1, "CHUNK_WORDS", size)
        assert sorted(r["doc_id"] for r in op1.stage(spark, frame(docs), str(tmp_path)).collect()) == [i for i, _ in docs if i % 2 == 0]


def test_leaks(spark, frame, monkeypatch):
    rng = random.Random(8)
    items = {k: words(rng, rng.randint(15, 50)) for k in range(30)}
    items[30], items[31] = ["only", "three", "words"], []
    docs, want = {}, set()
    for i in range(90):
        w = words(rng, rng.randint(20, 200))
        k = rng.randrange(30)
        if i % 3 == 0:
            part = list(items[k])
            if i % 2:
                cut = len(part) // 2
                part = part[cut:] + ["and"] + part[:cut]
            at = rng.randint(0, len(w))
            w[at:at] = part
            want.add((i, k))
        docs[i] = " ".join(w).upper() if i % 4 == 0 else ", ".join(w)
    docs[200] = "x ONLY three; words y"
    want.add((200, 30))
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items.items()] + [(40, None, 1)], "item_id long, text string, doc_id int")
    for size in (500_000, 60):
        monkeypatch.setattr(op1, "CHUNK_WORDS", size)
        got = op1.leaks(frame(docs.items()), bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(0.8 <= r["coverage"] <= 1 for r in got)
    assert op1.leaks(frame([]), bench).count() == 0 and op1.leaks(frame(ODD), bench.limit(0)).count() == 0
    assert op1.leaks(frame(ODD), bench).count() == 0


def test_leak_query_equals_brute_force(spark, documents):
    bench = {r["item_id"]: op1.words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    seeds: dict = {}
    for k, w in bench.items():
        for j in range(len(w) - 4):
            seeds.setdefault(tuple(w[j : j + 5]), set()).add(k)
    want = set()
    for d in documents:
        w = op1.words_of(d["text"])
        for k in {k for j in range(len(w) - 4) for k in seeds.get(tuple(w[j : j + 5]), ())}:
            if sum(n for _, _, n in slow_tiles(w, bench[k], 5)) >= 0.8 * len(bench[k]):
                want.add((d["doc_id"], k))
    assert {(r["doc_id"], r["item_id"]) for r in op1.query(spark, SMALL).collect()} == want


# --- pipeline


def slow_spans(left):
    """Passages of 50 words that an earlier text has at 0.8 or more, by words alone: first and last shared word of runs of such."""
    out: dict = {}
    texts = {i: t.lower().split() for i, t in left.items()}
    for i, w in texts.items():
        for j, v in texts.items():
            if j >= i or len(w) < 50 or len(v) < 50:
                continue
            where: dict = {}
            for k in range(len(v) - 4):
                where.setdefault(tuple(v[k : k + 5]), []).append(k)
            fars: dict = {}
            for k in range(len(w) - 4):
                for q in where.get(tuple(w[k : k + 5]), ()):
                    fars.setdefault(q - k, set()).add(k)
            good = set()
            for far, mine in fars.items():
                if len(mine) >= 20:
                    for s in range(max(0, -far), min(len(w) - 49, len(v) - 49 - far)):
                        if s not in good and sum(k in mine for k in range(s, s + 46)) >= 20 and jaccard(w[s : s + 50], v[s + far : s + far + 50]) >= 0.8:
                            good.add(s)
            run: list = []
            for s in [*sorted(good), None]:
                if run and (s is None or s - run[-1] > 46):
                    hit = [k for k in range(run[0], run[-1] + 46) if tuple(w[k : k + 5]) in where]
                    out.setdefault(i, []).append((hit[0], hit[-1] + 5 - hit[0]))
                    run = []
                run.append(s)
    return out


def test_pipeline_equals_brute_force(spark, documents):
    """Every stage again, by plain means, on what its predecessor kept."""
    from llm.test_text_ops import slow_components, slow_fingerprint

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    index = op9_toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scorer = op9_toxicity.Scorer(index.vocab, index)
    left = {d["doc_id"]: d["text"] for d in documents if scorer.score(d["text"])[0] < 0.3}
    root = slow_components({i: slow_fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if root[i] == i}

    spans = slow_spans(left)
    cut = {i: op2.without(t, spans.get(i, [])) for i, t in left.items()}
    cut = {i: t for i, t in cut.items() if t.strip() or not spans.get(i)}
    bench = [op1.words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {}
    for i, t in cut.items():
        w = op1.words_of(t)
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        hit = [b for b in bench if any(tuple(b[k : k + 5]) in have for k in range(len(b) - 4))]
        if not any(sum(n for _, _, n in slow_tiles(w, b, 5)) >= 0.8 * len(b) for b in hit):
            clean[i] = t
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    code = op3_bpe.codec(op3_bpe.default_tokenizer())
    assert set(got) == set(clean)
    differ = [i for i in clean if np.frombuffer(got[i]["ids_le"], "<u4").tolist() != code.encode(clean[i])]
    assert not differ


def test_stages_keep_columns(spark, frame):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (ODD, []):
            got = stage(spark, frame(rows), SMALL)
            assert got.schema.names == frame([]).schema.names, name
            assert got.count() <= len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]


def exact_repeats(docs, n=50):
    """(doc, first word) of the passages of n words that an earlier text has, by brute force."""
    seen, out = {}, set()
    for i, text in sorted(docs):
        w = text.lower().split()
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), i) < i:
                out.add((i, k))
    return out


def missed(found, docs):
    return [(i, k) for i, k in sorted(exact_repeats(docs)) if covers(found, i, k, k + 50) < 1]


def test_passage_whose_parts_are_in_earlier_texts(frame):
    """Earlier texts hold halves and pieces of a passage that only two later ones share."""
    for seed in range(3):
        rng = random.Random(70 + seed)
        docs, i = [], 0
        for _ in range(12):
            p = words(rng, 50)
            for lo, hi in ((0, 25), (20, 45), (25, 50), (5, 15), (12, 34)):
                docs.append((i := i + 1, " ".join(words(rng, 60) + p[lo:hi] + words(rng, 60))))
            for _ in range(2):
                docs.append((i := i + 1, " ".join(words(rng, 60) + p + words(rng, 60))))
        found = op2.find(frame(docs)).collect()
        assert exact_repeats(docs) and not missed(found, docs)


def test_repeats_inside_a_text(frame):
    """A passage twice in one text, and one of which a line also occurs earlier in its text."""
    rng = random.Random(8)
    p, q = words(rng, 50), words(rng, 50)
    docs = [(1, " ".join(words(rng, 40) + p + words(rng, 40))), (2, " ".join(words(rng, 30) + p + words(rng, 90) + p + words(rng, 30)))]
    docs += [(3, " ".join(words(rng, 40) + q + words(rng, 40))), (4, " ".join(q[15:27] + words(rng, 90) + q[15:27] + words(rng, 70) + q + words(rng, 9)))]
    docs += [(5, " ".join(p[:20] * 30)), (6, " ".join(words(rng, 60) + p[:20] * 9)), (7, "a b " * 900), (8, "a b " * 500)]
    found = op2.find(frame(docs)).collect()
    assert {i for i, _ in exact_repeats(docs)} == {2, 4, 6, 8} and not missed(found, docs)


def test_near_repeat_numbered_inside_its_window():
    """A line of the passage that occurs before it doesn't change the tokens of the window."""
    rng, memo = random.Random(9), op2._hasher()
    p = words(rng, 50)
    a, b = (op2._tokens(" ".join(x), memo) for x in (p[10:24] + words(rng, 80) + p, words(rng, 30) + p))
    _, best, shift = op2.similarities(a, b, [(30 - 94, 94, 94), (40, 0, 0)])
    assert [x[3] for x in op2.passages(a, b, best, shift)] == [1.0]


def jaccard(a, b):
    """Of two passages' 5-word shingles, repeats numbered."""
    from collections import Counter

    x, y = (Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def near_repeats(docs):
    """(doc, first word) of the 50-word passages that an earlier text has at 0.8 or more: all pairs of windows with a word run in common."""
    out, held = set(), {}
    for i, text in sorted(docs):
        w = text.lower().split()
        if len(w) < 50:
            continue
        at: dict = {}
        for k in range(len(w) - 4):
            for j, q in held.get(tuple(w[k : k + 5]), ()):
                at.setdefault(j, set()).add((k, q))
        for j, met in at.items():
            other = dict_of[j]
            for far in {q - k for k, q in met}:
                mine = {k for k, q in met if q - k == far}
                for s in range(max(0, -far), min(len(w) - 49, len(other) - 49 - far)):
                    if (i, s) not in out and sum(k in mine for k in range(s, s + 46)) >= 20 and jaccard(w[s : s + 50], other[s + far : s + far + 50]) >= 0.8:
                        out.add((i, s))
        for k in range(len(w) - 4):
            held.setdefault(tuple(w[k : k + 5]), []).append((i, k))
        dict_of[i] = w
    return out


dict_of: dict = {}


def test_first_holders_of_single_shingles_steal_nothing(frame):
    """Four earlier texts each hold one shingle of a passage that only two later ones share."""
    for seed in range(4):
        rng = random.Random(300 + seed)
        p = words(rng, 50)
        docs = [(k, " ".join(words(rng, 60) + p[k * 11 : k * 11 + 5] + words(rng, 60))) for k in range(4)]
        docs += [(100, " ".join(words(rng, 40) + p + words(rng, 40))), (101, " ".join(words(rng, 70) + p + words(rng, 10)))]
        docs += [(102, " ".join(p + words(rng, 60) + p))]
        found = op2.find(frame(docs)).collect()
        assert exact_repeats(docs) and not missed(found, docs)


def test_near_repeats_are_found(frame):
    """Passages with one word changed, put in or left out, at any place: recall against all windows."""
    rng = random.Random(77)
    docs, i = [], 0
    for case in range(90):
        p = words(rng, rng.randint(50, 90))
        q, k = list(p), rng.randrange(len(p))
        q[k : k + (case % 3 != 2)] = [] if case % 3 == 1 else [f"new{case}"]
        for x in (p, q):
            docs.append((i := i + 1, " ".join(words(rng, rng.randint(0, 60)) + x + words(rng, rng.randint(0, 60)))))
    dict_of.clear()
    need = near_repeats(docs)
    found = op2.find(frame(docs)).collect()
    lost = [(i, k) for i, k in need if covers(found, i, k + 5, k + 45) < 1]
    assert len(need) > 500 and len(lost) <= 0.01 * len(need)


def test_hubs_dealt_to_several_rows(frame, monkeypatch):
    monkeypatch.setattr(op2, "STAR", 4)
    monkeypatch.setattr(op2, "BATCH_WORDS", 300)
    rng = random.Random(5)
    p = words(rng, 70)
    docs = [(i, " ".join(words(rng, 20) + p[: 50 + i % 20] + words(rng, 20))) for i in range(40)]
    found = op2.find(frame(docs)).collect()
    assert not missed(found, docs) and all(r["source"] < r["id"] for r in found)


def test_string_ids(spark):
    rng = random.Random(6)
    p = " ".join(words(rng, 80))
    found = op2.find(spark.createDataFrame([("a", p), ("b", p), (None, p), ("c", None)], "doc_id string, text string")).collect()
    assert len(found) == 1 and {found[0]["id"], found[0]["source"]} == {"a", "b"}


def test_group_of_near_copies_has_few_rows_and_all_sources(frame):
    """Each text's passages are first in many others of the group: lists grow with it, not rows."""
    rng = random.Random(21)
    base, other = words(rng, 150, 10**6), words(rng, 150, 10**6)
    docs = [(i, " ".join(other[j] if rng.random() < 0.05 else w for j, w in enumerate(base))) for i in range(300)]
    found = op2.find(frame(docs)).collect()
    assert not missed(found, docs)
    text = {i: t.split() for i, t in docs}
    for r in found:
        assert all(a["source"] < r["id"] for a in r["also"])
        assert all(a["first_word"] >= r["first_word"] for a in r["also"])
        assert all(text[r["id"]][(k := a["first_word"]) : k + a["n_words"]] == text[a["source"]][(j := a["source_word"]) : j + a["n_words"]] for a in r["also"])
    held: dict = {}
    for r in found:
        held.setdefault(r["id"], []).extend((x["first_word"], x["first_word"] + x["n_words"]) for x in (r, *r["also"]))
    assert all(any(lo <= k and hi >= k + 50 for lo, hi in held[i]) for i, k in exact_repeats(docs))
    assert sum(len(r["also"]) for r in found) > 100


def test_rows_of_one_text_are_bounded():
    import pyarrow as pa

    kinds = {"rid": pa.int64(), "id": pa.string(), "source": pa.string(), "at": pa.list_(pa.int32()), "source_word": pa.int32(), "n_words": pa.int32(), "similarity": pa.float64()}
    place = lambda rid, c, of: (rid, f"t{rid}", of, [c], c + 3, None, None)
    many = [place(1, c, f"s{c}") for c in range(500)] * 2  # each passage is first in another text
    rows = [*many, place(2, 7, "s"), place(2, 8, "s"), place(2, 30, "q"), (2, "t2", "n", [20], 0, 80, 0.9), (2, "t2", "n", [20], 0, 80, 0.9), (3, "t3", "n", [0], 0, 60, 0.9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds.values())], names=list(kinds)) for part in (rows[:333], rows[333:333], rows[333:1001], rows[1001:])]
    got = [r for t in op2._by_text(batches) for r in op2.rows_of(t).to_pylist()]
    one = [r for r in got if r["rid"] == 1]
    assert len(one) <= 2 * 549 / 50 + 1 and covers(one, "t1", 0, 549) == 1
    assert sorted(x["source"] for r in one for x in (r, *r["also"])) == sorted(f"s{c}" for c in range(500))
    assert all(x["n_words"] == 50 and x["source_word"] == x["first_word"] + 3 for r in one for x in (r, *r["also"]))
    assert [(r["rid"], r["first_word"], r["n_words"], r["source"], r["similarity"], [tuple(a.values()) for a in r["also"]]) for r in got if r["rid"] > 1] == [(2, 7, 51, "s", 1.0, []), (2, 20, 80, "n", 0.9, [(30, 50, "q", 33)]), (3, 0, 60, "n", 0.9, [])]


def test_stage_cuts_what_rows_and_lists_hold(spark, frame):
    """What is only in a list is in the words of the text's rows, so the stage cuts it too."""
    rng = random.Random(22)
    base, other = words(rng, 150, 10**6), words(rng, 150, 10**6)
    docs = [(i, " ".join(other[j] if rng.random() < 0.05 else w for j, w in enumerate(base))) for i in range(200)]
    spans: dict = {}
    for r in op2.find(frame(docs)).collect():
        spans.setdefault(r["id"], []).extend((x["first_word"], x["n_words"]) for x in (r, *r["also"]))
    cut = {i: op2.without(t, spans.get(i, [])) for i, t in docs}
    kept = {r["doc_id"]: r["text"] for r in op2.stage(spark, frame(docs), SMALL).collect()}
    assert kept == {i: t for i, t in cut.items() if t.strip()} and len(kept) < len(docs)
