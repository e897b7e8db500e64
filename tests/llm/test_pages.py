"""The operators on pages: main text and URL filters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import main_text, url_filters
from tests.conftest import rows

PAGE = """<!doctype html><html><head><title>T</title><script>var menu = "<p>no</p>";</script><style>p {{}}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>
<div id="cookie" class="notice">We use cookies on this site. <button>Accept</button></div>
<div class="content"><h1>A title &amp; more</h1>
<p>{one}</p><p>Second   paragraph,
with <b>bold</b> text and <a href="/x">one link</a> inside of a longer sentence that goes on for a while.</p><ul><li>first point of the list</li></ul></div>
<aside class="sidebar"><a href="/1">Related one</a><a href="/2">Related two</a></aside>
<footer>Copyright &copy; 2020 <a href="/terms">Terms</a></footer></body></html>"""
ONE = "The first paragraph has quite some words, so that its density is high, and it ends here&#33; " * 3


def test_article_without_its_surroundings():
    text = main_text.main_text(PAGE.format(one=ONE))
    blocks = text.split("\n\n")
    assert blocks[0] == "A title & more" and blocks[1] == re.sub(r"\s+", " ", ONE.replace("&#33;", "!")).strip()
    assert blocks[2].startswith("Second paragraph, with bold text and one link inside") and blocks[3] == "first point of the list"
    assert len(blocks) == 4


SENTENCES = "<p>" + "The article has many words that stand in a sentence of some length here. " * 6 + "</p>"


@pytest.mark.parametrize("page", [
    f'<div><p class="ad">Buy now{SENTENCES}{SENTENCES}</div>',
    f'<ul><li class="share">tweet<li class="share">mail</ul>{SENTENCES}{SENTENCES}',
    f"<div><aside>side note</div>{SENTENCES}{SENTENCES}",
    f'<div class="content with-sidebar">{SENTENCES}{SENTENCES}<div class="sidebar">more to see</div></div>',
    f'<article class="post related-topics-none comment-open">{SENTENCES}{SENTENCES}</article><div class="comments"><p>A first reader says a lot about it.</div>',
    f'<main id="main-banner-page">{SENTENCES}{SENTENCES}</main>',
    f"<div>{SENTENCES}{SENTENCES}</div><ul><li><a href=/foo/>Menu one</a><li><a href=/bar/>Menu two</a></ul>",
    f"<head><title>x</title><body><div>{SENTENCES}{SENTENCES}</div>",
    f'<form id="page"><div>{SENTENCES}{SENTENCES}</div><input value="x"></form>',
    f"<nav><ul><li>one<li>two</nav><div>{SENTENCES}{SENTENCES}</div>",
])
def test_the_article_survives_loose_markup_and_wrappers(page):
    one = " ".join(SENTENCES[3:-4].split())
    assert main_text.main_text(page) == f"{one}\n\n{one}"


def test_comments_longer_than_the_article_go():
    one = " ".join(SENTENCES[3:-4].split())
    assert main_text.main_text(f'<article>{SENTENCES}</article><div id="comments">{SENTENCES * 8}</div>') == one


def test_every_page_comes_back(spark):
    listed = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<<<>>&&#x;&#99999999;</b></p>"), (4, "u", "<<<>>&&#x;&#99999999;</b></p>"),
              (5, "u", "<div>" * 5000 + "deep words"), (6, "u", PAGE.format(one=ONE * 2000))]
    found = main_text.extract(spark.createDataFrame(listed, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0) for r in found) == [0, 1, 2, 4, 4, 5, 6]
    assert all(r.n_chars == len(r.text) for r in found)
    assert {r.page_id: r.text for r in found}[1] == "" and {r.page_id: r.text for r in found}[2] == ""
    assert {r.page_id: r.n_chars for r in found}[6] > len(ONE) * 1900
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def parts(url):
    """Host, path and rule by the plain rules."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = re.sub("[A-Z]+", lambda m: m.group().lower(), rest[:at]), rest[at:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


@pytest.mark.parametrize("case", ["awkward", "table", "empty"])
def test_rules_of_urls(spark, small, case):
    if case == "table":
        table = spark.read.parquet(f"{small}/pages.parquet")
    else:
        urls = [None, "", "example.org/es/x", "http://example.org/es/x", "HTTP://EXAMPLE.ORG/en/12", "a://notexample.org/es/", "a://b.example.org/es/?q#f", "x://y://z/de/",
                "x://", "x://com/de/1", "x://shop.com/de/", "x://shop.com/fr/a", "x://shop.com/Fr/", "x://a?b/c", "x://a#://b/", "x://com./de/", "http://q.net/a b/é"] if case == "awkward" else []
        table = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + ([(None, "x://com/de/", "h", "p")] * 2 if urls else []), "page_id long, url string, host string, path string")
    found = url_filters.judge_urls(table).select("page_id", "host", "path", "rule", "verdict")
    want = [(r.page_id, *parts(r.url)) for r in table.collect()]
    assert rows(found, "page_id", "host", "path", "rule") == sorted((w[:4] for w in want), key=repr)
    assert rows(found.filter("rule is not null"), "page_id", "verdict") == sorted(((w[0], w[4]) for w in want if w[4]), key=repr)
    assert found.filter("verdict is null or verdict not in ('allow', 'block')").count() == 0


def test_a_bad_template_is_rejected(spark):
    """A host whose labelled pages below /offer are bad and below /post are good; ids vary."""
    listed = [(i, f"https://h.example/{'offer' if i % 2 else 'post'}/{i * 7919}/view", i % 2 if i < 200 else None) for i in range(400)]
    pages = spark.createDataFrame(listed, "page_id long, url string, bad int")
    found = url_filters.judge_urls(pages, label=pages["bad"]).collect()
    assert len(found) == 400 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in found)
    assert len({r.template for r in found}) == 2


def tree_of(pages):
    """Template and rate of each (host, segments) by a plain recursion; `pages` are (host, segments, bad, good)."""
    smooth = lambda bad, good, p: (bad + url_filters.SMOOTHING * p) / (bad + good + url_filters.SMOOTHING)
    out = {}

    def grow(rows, at, template, p):
        bad, good = sum(r[2] for r in rows), sum(r[3] for r in rows)
        rests = [r[1][at[r]:] for r in rows]
        if not (bad and good) or not any(rests):
            for r, rest in zip(rows, rests):
                out[r[:2]] = (template + "/~" if rest and rest != ("$",) else template, p)
            return
        skip = 0
        while all(len(x) > skip for x in rests) and len({x[skip] for x in rests}) == 1:
            skip += 1
        way = template + "".join("/" + s for s in rests[0][:skip] if s != "$")
        groups = {}
        for r, rest in zip(rows, rests):
            groups.setdefault(rest[skip] if len(rest) > skip else "", []).append(r)
        few = sum(sum(r[4] for r in g) < url_filters.RARE for g in groups.values())
        named = {}
        for seg, g in groups.items():
            b, labelled, mean = sum(r[2] for r in g), sum(r[2] + r[3] for r in g), bad / (bad + good)
            alike = abs(b - labelled * mean) <= url_filters.SIMILAR * (labelled * mean * (1 - mean)) ** 0.5
            rare = few > url_filters.CHILDREN and sum(r[4] for r in g) < url_filters.RARE
            named.setdefault(way if seg in ("", "$") else way + "/*" if rare else way + "/~" if alike else way + "/" + seg, []).extend(g)
        for name, g in named.items():
            b, o = sum(r[2] for r in g), sum(r[3] for r in g)
            grow(g, {r: at[r] + skip + 1 for r in g}, name, p if (b, o) == (bad, good) else smooth(b, o, p))

    for host in {r[0] for r in pages}:
        rows = [r for r in pages if r[0] == host]
        grow(rows, dict.fromkeys(rows, 0), "", smooth(sum(r[2] for r in rows), sum(r[3] for r in rows), url_filters.PRIOR))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_templates_equal_a_plain_recursion(spark, seed):
    draw = random.Random(seed)
    seen = {}
    for _ in range(1500):
        depth = draw.randint(0, 7)
        path = [draw.choice(["news", "shop"])] if depth else []
        path += [draw.choice(["a", "b", "{n}", draw.choice("xyz") * draw.randint(1, 12)]) for _ in range(depth)]
        bad = draw.random() < (0.9 if "b" in path[:3] else 0.1)
        seen.setdefault((draw.choice(["h", "k"]), (*path, "$")), []).append(draw.choice([None, bad]))
    pages = [(h, s, sum(v is True for v in given), sum(v is False for v in given), len(given)) for (h, s), given in seen.items()]
    table = spark.createDataFrame([(h, list(s), b, g, n) for h, s, b, g, n in pages], "host string, segments array<string>, bad long, good long, n long")
    found = {(r._th, tuple(r._ts)): (r.template, r.block_rate) for r in url_filters.templates(table).collect()}
    want = tree_of(pages)
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    assert len({t for t, _ in want.values()}) > 10


def test_branches_that_part_deep_in_the_path(spark):
    listed = [(i, f"https://h.example/de/2024/05/{'offer' if i % 2 else 'post'}/x{'y' * (i // 2)}", i % 2) for i in range(400)]
    found = url_filters.judge_urls(spark.createDataFrame(listed, "page_id long, url string, bad int"), label=F.col("bad")).collect()
    assert len(found) == 400 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in found)


def test_a_frequent_branch_among_many_rare_ones_keeps_its_name(spark):
    listed = [(i, f"https://h.example/slug-{'q' * i}z", 0) for i in range(300)] + [(1000 + i, "https://h.example/offer", 1) for i in range(900)]
    found = url_filters.judge_urls(spark.createDataFrame(listed, "page_id long, url string, bad int"), label=F.col("bad")).collect()
    assert {(r.template, r.verdict) for r in found} == {("/offer", "block"), ("/*", "allow")}
