"""Wrappers decide: sites without telling names, quantifiers, bounds of size, depth."""

import random

import pytest

from radarlake.llm import op4_wrappers as op4

NAMES = {"top": "xk", "menu": "qf", "ad": "zz", "body": "kr", "talk": "vo", "one": "wub", "foot": "jem", "hint": "mu"}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def site(rng, names, pages=12):
    """Pages of one host without an article element: (html, main text)."""
    out = []
    for k in range(pages):
        title, parts = sentence(rng, 6), [sentence(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        talk = "".join(f'<div class="{names["one"]}"><b>{sentence(rng, 2)}</b><div>{sentence(rng, rng.randint(30, 90))}</div></div>' for _ in range((0, 1, 9)[k % 3]))
        ad = f'<div class="{names["ad"]}">{sentence(rng, 9)}</div>' if k % 2 else ""
        html = (
            f'<html><body><div class="{names["top"]}">Our Site, since ever</div><div class="{names["menu"]}"><ul>' + "".join(f"<li><a href=/{j}>{sentence(rng, 2)}</a>" for j in range(6)) + "</ul></div>"
            f'{ad}<div class="{names["body"]}"><h1>{title}</h1><div class="{names["hint"]}">This page is set in the public interest.</div>' + "".join(f"<p>{x}</p>" for x in parts) + "</div>"
            f'<div class="{names["talk"]}">{talk}</div><div class="{names["foot"]}">All the rest</div></body></html>'
        )
        out.append((html, " ".join([title, *parts])))
    return out


def host_rules(pages):
    w = op4.wrapper(op4.parse(pages[0]))
    for p in pages[1:]:
        w = op4.align(w, op4.loads(op4.dumps(op4.wrapper(op4.parse(p)))))
    return op4.rules(w), w


@pytest.mark.parametrize("seed", range(5))
def test_a_site_without_telling_names(seed):
    pages = site(random.Random(seed), NAMES)
    rule, w = host_rules([h for h, _ in pages])
    assert [op4.main_text(h, rule) for h, _ in pages] == [t for _, t in pages]
    # without the host's wrapper the pages with many comments or a fixed hint are read wrongly
    assert sum(op4.main_text(h, None) != t for h, t in pages) >= len(pages) // 2
    other = {k: v[::-1] + "0ab" for k, v in NAMES.items()}
    again = site(random.Random(seed), other)
    assert [op4.main_text(h, host_rules([h for h, _ in again])[0]) for h, _ in again] == [t for _, t in pages]
    text = op4.expression(w)
    assert "|" not in text and f"<div.{NAMES['ad']}>(#text)?" in text and f"<div.{NAMES['one']}>" in text and "<p>(#text)+" in text


def test_words_only_break_ties():
    """The element that holds a host's text is kept whatever it is called."""
    rng = random.Random(3)
    pages = [f'<body><div class="search-results widget"><h1>{sentence(rng, 5)}</h1><p>{sentence(rng, 60)}<p>{sentence(rng, 40)}</div><div class="ad">{sentence(rng, 12)}</div></body>' for _ in range(5)]
    rule, _ = host_rules(pages)
    for p in pages:
        text = op4.main_text(p, rule)
        assert len(text.split()) == 105 and text.split()[0] in p


def test_wrappers_are_bounded():
    rng = random.Random(4)
    body = "".join(f'<section class="c{chr(97 + k % 26)}{chr(97 + k // 26)}"><p>text {k} and more</p></section>' for k in range(600))
    pages = [f"<body><article>{body}<p>{sentence(rng, 30)}</p></article></body>" for _ in range(3)]
    rule, w = host_rules(pages)
    assert max(len(x[5]) for _, x in op4._flat(w)) <= op4.WIDE and len(op4._flat(w)) <= op4.MOST_NODES
    assert op4.main_text(pages[0], rule) == op4.main_text(pages[0], None) and "text 599 and more" in op4.main_text(pages[0], rule)
    rows = "".join("<div>" * (k % 7) + "".join(f"<{t}>a{k}</{t}>" for t in "abcdefghijklm") + "</div>" * (k % 7) for k in range(900))
    w = op4.wrapper(op4.parse("<div>" * 300 + "".join(f"<t{k}>{rows}</t{k}>" for k in range(60))))
    assert len(op4._flat(w)) <= op4.MOST_NODES


def test_partial_wrappers_meet_in_rounds(spark, monkeypatch):
    pages = [(k, f"http://h.test/{k}", h) for k, (h, _) in enumerate(site(random.Random(9), NAMES, 40))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(16)
    want = {r["page_id"]: r["text"] for r in op4.extract(df).collect()}
    monkeypatch.setattr(op4, "FAN", 3)
    assert {r["page_id"]: r["text"] for r in op4.extract(df).collect()} == want
    deep = "<div>" * 3000 + "<p>deep one</p>" + "</div>" * 3000
    got = op4.extract(spark.createDataFrame([(1, "http://d.test/", deep), (2, "http://d.test/", "<article><p>x</article>" + deep)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: "deep one", 2: "x"}
