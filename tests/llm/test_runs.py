"""Periodic runs, page extraction and the filter audit on small inputs."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import Row

from geodiag.llm import extraction, interactions, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t", "word", "a" * 5000, "é 漢字 ▁ ​ 😀", "x " * 3000, "x x x x x x", "a b " * 9 + "c"]


# --- 11
def all_runs(w, least, periods):
    """Every lag, every maximal stretch of equal words at that lag."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, periods * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda x: (x[0], x[2]))


def test_runs_are_all_runs():
    r = random.Random(7)
    for _ in range(4000):
        w = [r.choice("abcd"[: r.choice([1, 2, 2, 3, 4])]) for _ in range(r.randrange(40))]
        if r.random() < 0.6:
            w = w[:5] + w[: r.randrange(1, 8)] * r.randrange(1, 8) + w[:3] + w[1 : r.randrange(2, 9)] * r.randrange(1, 5)
        for least, periods in ((2, 2), (6, 4), (1, 3), (5, 2.5)):
            assert runs.runs(w, least, periods) == all_runs(w, least, periods), (w, least, periods)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("w", [fibonacci(1500), list("ab" * 500), ["a"] * 700, list("aab" * 50 + "aac" * 60), list("abcabcabd" * 40), sorted("abc" * 90), list("zyx" * 3 + "y" * 200 + "zyx" * 60)])
def test_runs_of_repetitive_texts(w):
    assert runs.runs(w, 2, 2) == all_runs(w, 2, 2)


def test_time_is_linear():
    """Eight times the words take no more than some 16 times the time, for texts on which plain matching is quadratic."""
    for make in (lambda n: ["a"] * n, fibonacci, lambda n: list("ab" * (n // 2)), lambda n: ["a"] * (n // 2) + ["b"] + ["a"] * (n // 2)):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            runs.runs(make(n), 2, 2)
            took.append(time.process_time() - began)
        assert took[1] < 16 * took[0] + 0.2


def test_words_need_only_an_order():
    class Word(str):
        __hash__ = None

    w = [Word(x) for x in "b a b a b a b a c".split()]
    assert runs.runs(w) == [(0, 8, 2)]


def test_digests_equal_brute_force(spark):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(1, 120))) for _ in range(150)]
    rows = [(i if i % 37 else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[12], "clash")] * 2
    got = sorted(runs.digest_runs(spark.createDataFrame(rows, "doc_id long, text string, period string").repartition(3), planted=True).collect(), key=lambda x: str(tuple(x)))
    want = []
    for doc_id, text, _ in rows:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if doc_id is not None and n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = all_runs(w, 6, 4)
        drop = {k for s, m, p in found for k in range(s + p, s + m)}
        first = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        text = " ".join(x for k, x in enumerate(w) if k not in drop)
        want.append(Row(doc_id, len(found), *first, 1000 * first[1] // first[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=lambda x: str(tuple(x))) and sum(x[1] > 0 for x in want) >= 10
    assert runs.digest_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_and_collapsed_texts(spark):
    got = {r.doc_id: r for r in runs.find_runs(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()}
    assert got[8].runs == [Row(start=0, length=18, period=2)] and got[8].collapsed == "a b c" and got[8].n_words == 19
    assert got[7].collapsed == "x" and got[6].n_words == 3000 and got[6].collapsed == "x" and got[1].collapsed == "" and got[1].runs == [] and got[3].collapsed == "word"


# --- 12
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. "
BARE = f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td></tr></table><div><div><h1>Title</h1><p>{LONG * 2}</p><p>Be.</p></div></div><div><div><div><div><div>Copyright 2020</div></div></div></div></div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=/>Home</a></nav><footer>(c)</footer>", ""),
        ("<article><h1>Be.</h1><p>Er.</p></article><footer>much longer than the article is</footer>", "Be.\nEr."),
        (f"<body class='has-sidebar'><nav>{LONG}</nav><div class=ad>{LONG}</div><article><h1>A &amp; B &#x41;&eacute;</h1><p><b>One.<br><p>two\n  <i>three</i>four&nbsp;five</article><footer>{LONG}", "A & B Aé\nOne.\ntwo threefour five"),
        (f"<main><article><header><h1>T</h1><p class=byline>By X</p></header><p>One.<aside>{LONG}</aside><p>Two<ul><li>a<li>b</ul><div class='ad-slot'>{LONG}</div><p>Three<section id=comments><article class=comment><p>{LONG * 5}</p></article></section></article></main>", "T\nOne.\nTwo\na\nb\nThree"),
        (f"<div class='cookie-notice'>{LONG * 4}</div><div class='content'><h2>T</h2><p>text &lt;b&gt;</p></div><aside class='sidebar'>{LONG * 3}</aside><form><label>Name</label><p>{LONG * 3}</p></form>", "T\ntext <b>"),
        (f"<div class=post><p>A < B and c > d<script>var t='</p>';</script><style>p{{x}}</style><!-- no --> e</p><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><!-- never closed {LONG}", "A < B and c > d e"),
        (f"<form action=x><div id=page><h1>T</h1><p>{LONG * 2}</p></div></form>", "T\n" + (LONG * 2).strip()),
        (BARE, "Title\n" + (LONG * 2).strip() + "\nBe."),
        ("<p>two lines<br>one block</p>" + f"<p>{LONG * 2}</p>", "two lines one block\n" + (LONG * 2).strip()),
    ],
)
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_surge_and_dive_points():
    import numpy as np

    # one block of much text with short lines in it, a gap of a window, and little text
    weight, at = np.array([5, 0, 90, 3, 4, 8]), np.array([2, 4, 6, 8, 15, 17])
    assert extraction.surges(weight, at).tolist() == [True, True, True, True, False, False]
    assert extraction.surges(weight, at, 1).all() and not extraction.surges(weight, at, 1000).any()
    assert not extraction.surges(np.zeros(3), np.arange(3)).any()


@pytest.mark.parametrize("page", ["<" * 200_000, "<div " * 50_000, "<div>" * 50_000 + "x", '<a b="' * 50_000, "<b><p>" * 30_000, "&" * 99_999, "<!--" * 50_000, "<li>" * 50_000, "<x " + "a='" * 100_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - began < 5


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article><p>é 漢</p></article>", "x"), (2, "v", "<article><p>a</p></article>", "x"), (2, "v", "<article><p>a</p></article>", "x")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "", 0), (None, None, "é 漢", 3), (2, "v", "a", 1), (2, "v", "a", 1)], key=str)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 13
def plain_audit(docs, labels):
    good, bad = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    out, first = {}, {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d,
        }
        rows.append((lang or "", fails, d in good, d in bad))
    for part in {r[0] for r in rows}:
        mine, shapley, steps = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in mine) - len(gone)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, only, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        for *s, f in steps:
            out[tuple(s[:3])] = (*s, shapley[f])
    return out


def some_documents():
    r = random.Random(11)
    texts = [" ".join(r.choice(["the", "of", "Big", "cat#", "x"]) + r.choice(["", "1", "2", "aa", "bb"]) for _ in range(r.choice([5, 190, 210, 400]))) for _ in range(40)] + ["", None, "A", "\t\n"]
    docs = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(300)]
    docs += [(7, docs[7][1], "en"), (7, docs[7][1], "en"), (7, "other", "en"), (None, docs[3][1], "en"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = some_documents()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, mask int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels)
    got = {tuple(r)[:3]: tuple(r) for r in interactions.audit(frame, known).collect()}
    assert got == want and len(want) == 600 * 3
    ids = set(interactions.repeated_ids(frame).collect())
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    assert ids == {d for d, t, _ in docs if d is not None and first[t or ""] < d}
    empty = spark.createDataFrame([], frame.schema)
    assert interactions.audit(empty, known).count() == 0
    assert interactions.audit(frame, spark.createDataFrame([], known.schema)).agg({"good_lost": "sum"}).first()[0] == 0


def test_chains_tell_texts_with_one_fingerprint_apart():
    c = interactions.Chains()
    assert c.offer(1, "a", 5, {"p": 1}) is None and c.offer(1, "b", 6, {"p": 1}) is None and len(c.chains[1]) == 2
    assert c.offer(1, "a", 3, {"p": 1}) == (5, {"p": 1}) and c.offer(1, "a", 4, {"q": 1}) == (4, {"q": 1}) and c.offer(1, "a", 3, {"q": 2}) is None
    assert sorted(map(tuple, (e for _, e in c.drain())), key=str) == [("a", 3, {"p": 1, "q": 2}), ("b", 6, {"p": 1})] and not c.chains and c.held == 0


def test_map_side_lets_go_of_texts(monkeypatch):
    monkeypatch.setattr(interactions, "HELD", 20)
    monkeypatch.setattr(interactions, "EMITTED", 1)
    docs, _ = some_documents()
    rows = [(hash(t or "") % 7, d, t or "", lang or "", 0) for d, t, lang in docs]
    sent = list(interactions._map_side(iter(rows)))
    out = list(interactions._reduce_side(iter(sent)))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    assert sum(r[3] for r in out) == len(docs)
    assert sum(r[3] for r in out if r[2] & interactions.COPY) == sum(d is not None and first[t or ""] < d for d, t, _ in docs)
