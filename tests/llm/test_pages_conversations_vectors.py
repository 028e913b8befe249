"""Page extraction, the conversation trie and whitening against plain versions, and on odd rows."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from transitloom.llm import html_text, prefix_trie, whitening
from transitloom.llm.queries import QUERIES

MORE = "/root/testdata/sf0.01"
WORDS = "A paragraph of some words, with commas, and of a length that readers would take for text. "


def rows_of(name):
    return pq.read_table(f"{MORE}/{name}.parquet").to_pylist()


# pages


def plain_article(page):
    """The blocks of the article element, which these pages all have: cut at block tags, other tags dropped."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub(r"<[a-z/!][^>]*>", "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_whole_articles_of_all_pages(spark):
    want = {r["page_id"]: (r["url"], plain_article(r["html"])) for r in rows_of("pages")}
    got = QUERIES["op11_html_text"](spark, MORE).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


LAYOUTS = {
    "around a container": (f"<div id=header><h1>Site</h1></div><div class=menu><a href=x>Home</a></div><div class=wrap><div class=content><h2>Title</h2><p>{WORDS * 3}<p>Short.<ul><li>one<li>two</ul></div><div class=sidebar><p>{WORDS}</div></div><div id=comments><p>{WORDS * 9}</div>", ["Title", WORDS * 3, "Short.", "one", "two"]),
    "parts of an article": (f'<article><header><h1>Title</h1><p>by someone</p></header><p>{WORDS}</p><aside>pulled</aside><form><p>{WORDS}</p></form><div class="share-bar">share</div><p>end</p><section class=comments><p>{WORDS * 9}</p></section></article>', ["Title", WORDS, "end"]),
    "siblings": (f"<div>{WORDS}</div><div>{WORDS}</div><div><a href=x>{WORDS}</a></div>", [WORDS, WORDS]),
    "cells": (f"<table><tr><td><a href=1>menu</a><td><p>{WORDS * 2}<p>{WORDS}<br>{WORDS}<tr><td>{WORDS}</table>", [WORDS * 2, WORDS * 2, WORDS]),
    "short main": (f"<main><h1>T</h1><p>one</p><p>two</p></main><div class=cookie-notice><p>{WORDS * 4}</p></div>", ["T", "one", "two"]),
    "references": ("<article><p>a&amp;b &#65;&#x42; &eacute; &am &nbsp; a < b<p>c<!-- d -->e</article>", ["a&b AB é &am a < b", "ce"]),
    "unseen": (f"<article><p>{WORDS}<svg><title>no</title></svg><noscript>no</noscript><p hidden>no<p style='display: none'>no</article>", [WORDS]),
    "broken": (f"</div><p>{WORDS}</b></p><script>var t = '<p>no</p>'", [WORDS]),
    "open comment": (f"<p>{WORDS}</p><!-- <p>no</p>", [WORDS]),
    "no article": ("<nav><a href=x>no</a></nav><div class=ad>no, no, no and no again, as long as a text would be</div><article></article><footer>no</footer>", []),
    "text alone": ("just &lt;text", ["just <text"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, blocks = LAYOUTS[name]
    assert html_text.main_text(page) == "\n\n".join(b.strip() for b in blocks)


def test_points_by_hand():
    page, blocks = html_text.read_page(f"<div><div><p>{'x' * 200},</p></div><p>abc <a href=x>defg</a></p></div>")
    outer, inner = 1, 2
    first, second = 1 + 1 + 2.01, 1 + 0 + 0.08
    got = html_text.points(page, blocks)
    assert got[inner] == pytest.approx(5 + first)
    assert got[outer] == pytest.approx((5 + first / 2 + second) * (1 - 4 / 209))


def test_hostile_pages_end():
    for page in ("<div>" * 50_000 + "x", "<p><b>" * 20_000 + "x", "<" * 100_000, "<!--" * 50_000, "<ul><li>" * 20_000 + "x", "</div>" * 50_000, "<a " + "x=1 " * 20_000 + ">x"):
        html_text.main_text(page)
    assert html_text.main_text("<div>" * 50_000 + "deep text") == "deep text"
    assert len(html_text.main_text("<article><p>" + "wörd, " * 300_000)) == 6 * 300_000 - 1


def test_odd_pages(spark):
    rows = [(1, None, None, "t", 5), (2, "u", "", None, 5), (2, "u", "", None, 5), (None, "v", "<p>some text here", "t", None), (4, "w", "<p>x</p>" * 5000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    told = sorted((tuple(r) for r in got.collect()), key=repr)
    assert told == sorted([(1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0), (None, "v", "some text here", 14), (4, "w", "\n\n".join("x" * 5000), 14998)], key=repr)
    assert html_text.extract_pages(pages.filter("false")).count() == 0


# conversations


def plain_trie(rows):
    """Every node by walking every rebuilt conversation; rows are (conv_id, turn, role, text)."""
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in own.items()}
    members = collections.defaultdict(list)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    below = collections.defaultdict(set)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below[node])
    return sorted(
        (min(ids), len(node), min(members[node[:-1]]) if node else -1, len(ids), len(below[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(c for c in ids if whole[c] == node))).encode()).hexdigest())
        for node, ids in members.items()
    )


def told(trie):
    return sorted(tuple(-1 if v is None else v for v in (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in trie.collect())


ODD = [
    *[(c, t, "user", f"hi {c % 3} {t}") for c in range(1, 260) for t in range(c % 4)],
    *[(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(9)],  # equal whole texts, split by h
    *[(c, 1, "user", "lone") for c in range(1000, 1010)],
    (500, None, None, None), (500, 1, "user", None), (500, 1, None, "x"), (500, 1, None, "x"), (501, 2, "a", "é" * 40_000), (503, 0, "ab", "c"), (504, 0, "a", "bc"),
    (None, 1, "user", "no conversation"), (-5, 0, "user", "below zero"), (-105, 3, "user", "below zero"), *[(-100, t, "user", f"z{t}") for t in range(7)], (2**40, 1, "user", "far"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, None, 1, "k") for r in ODD]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, n_convs int, key string").repartition(5)


def test_trie_of_odd_rows(odd):
    assert told(prefix_trie.conversation_trie(odd)) == plain_trie(ODD)


def test_trie_in_one_shard_and_in_many(odd, spark):
    for count in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", count)
        try:
            assert told(prefix_trie.conversation_trie(odd)) == plain_trie(ODD)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_with_dealt_joins(odd, monkeypatch):
    from transitloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(common.if_small, "__defaults__", (-1,))
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    assert told(prefix_trie.conversation_trie(odd)) == plain_trie(ODD)


def test_trie_of_all_conversations(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    assert told(QUERIES["op12_prefix_trie"](spark, MORE)) == plain_trie(rows)


def test_trie_of_nothing(odd):
    assert prefix_trie.conversation_trie(odd.filter("false")).count() == 0
    assert prefix_trie.conversation_trie(odd.filter("conv_id is null")).count() == 0


def test_siblings_are_balanced():
    """Sorted sequences do not make a chain of the siblings: an even fan of 1,023 is ten deep."""
    tree = prefix_trie.TernaryTree()
    tree.fill([([k], [1], 1, k, "") for k in range(1023)])

    def deep(node):
        return 0 if node < 0 else 1 + max(deep(tree.low[node]), deep(tree.high[node]))

    assert deep(tree.below[0]) == 10


# vectors


def plain_whitening(vectors, most=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    far = n * x.astype(object) - s.astype(object)
    centred = far.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return (far**2).sum(1), centred @ axes[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def compare(rows, ids, vectors, components=8):
    deviation, white, explained = plain_whitening(vectors)
    at = {k: i for i, k in enumerate(ids)}
    got = np.zeros((len(ids), components))
    assert len(rows) == len(ids) * components
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviation[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * white[:, :components]).sum(0)) - white[:, :components]).max() < 1e-9


def test_whitening_of_all_vectors(spark):
    rows = rows_of("embeddings")
    compare(QUERIES["op13_whitening"](spark, MORE).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in rows], f"vec_id long, embedding array<{kind}>, n int, component int").repartition(3)


def test_whitening_leaves_out_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 3 * 7)  # seven rows a block
    good = np.random.default_rng(5).normal(size=(100, 3)).astype(np.float32).tolist()
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0]), (206, [3e38, 0.0, 0.0])]
    compare(whitening.whiten(vectors_of(spark, [*enumerate(good), *bad])).collect(), range(100), good, 3)


def test_whitening_of_repeated_rows(spark):
    good = np.random.default_rng(6).normal(size=(40, 4)).tolist()
    rows = [*enumerate(good), (7, good[7]), (7, good[8]), (None, good[9])]
    got = whitening.whiten(vectors_of(spark, rows, "double")).collect()
    assert len(got) == 43 * 4 and sum(r.vec_id == 7 for r in got) == 12 and sum(r.vec_id is None for r in got) == 4 and {r.n for r in got} == {43}


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    none = whitening.whiten(vectors_of(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whiten(vectors_of(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-9 for r in line)


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(vectors_of(spark, [(1, [2.0**38, 1.0]), (2, [-(2.0**38), 0.0]), (3, [0.0, 0.5])], "double")).collect()
    assert all((r.deviation is None) == (r.vec_id != 3) for r in got) and got
