"""MinHash and embedding operators against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from geodiag.llm import minhash
from geodiag.llm.components import connected_components
from geodiag.llm.embeddings import link_vectors, plan_tables
from geodiag.llm.minhash import BINS, _star_links, band_keys, densify, near_duplicates, plan_bands

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(3, 200))] for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(r.choice((1, 1, 3, 12))):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    rows += ["", None, "one", "One", "two words", " \n", "x " * 500, "漢字 é Ü"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in near_duplicates(docs, k, percent).collect()}
    sets = {i: shingle_set(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (0, 0, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_links_that_no_star_centre_has(spark):
    # one crowded bucket; its first centre, 0, links with nothing
    sets = {i: list(range(1000 * i, 1000 * i + 20)) for i in range(12)}
    sets[7] = [*sets[5][:19], 1]
    sets[11] = [*sets[9][:19], 2]
    members = spark.createDataFrame([(1, i, 20, 100 if i == 0 else 12) for i in sets], "key long, rep long, n long, degree long")
    links = _star_links(members, spark.createDataFrame(list(sets.items()), "doc_id long, shingles array<long>"), 80)
    assert {(r.a, r.b) for r in links.collect()} == {(5, 7), (9, 11)}


def test_bands_and_densification():
    for percent in (80, 85, 95):
        bands, rows = plan_bands(percent)
        assert bands * rows <= BINS and (1 - (percent / 100) ** rows) ** bands <= 1e-5
    full = np.zeros((2, BINS), bool)
    full[:, 7] = True
    sig = np.where(full, np.uint64(5), np.uint64(0))
    out = densify(sig, full)
    assert (out[0] == out[1]).all() and (out != 0).all()
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64))
    assert (band_keys(x, np.array([0, 50]), 5, 4) == band_keys(np.concatenate([x, x]), np.array([0, 50, 100]), 5, 4)[1]).all()


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(300)] + [(7, 3), (3, 9), (9, 7), (11, 11), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[500 + i] == 500 for i in range(301))
    assert got[3] == got[7] == got[9] == 3 and 11 not in got and 4 not in got


def vectors(seed=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((30, 16))
    rows = [c + 0.08 * r.standard_normal(16) for c in centres for _ in range(int(r.choice([1, 2, 9])))]
    rows = [v.astype(np.float32).tolist() for v in rows]
    return rows + [rows[0], rows[0], rows[3], [0.0] * 16, None, [], [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [1.0] * 15]


def test_vectors_match_all_pairs(spark):
    rows = vectors()
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>"), block=8).collect()}
    ok = {i: np.array(v, float) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95:
                links[a].add(b)
    comp = components(range(len(rows)), [(a, b) for a in links for b in links[a]])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in range(len(rows))}


def test_no_vectors(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    bits, tables = plan_tables(10**6, 0.95)
    assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4


def test_pairs_left_apart_are_compared_in_blocks(spark, monkeypatch):
    """Near copies just below the threshold, in one bucket: each link that no star has is found, and no row is made for a pair."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(12)
    base, sets = list(range(100)), {}
    for i in range(60):  # 12 of 100 replaced, so two have 79 or so of 121 in common
        gone = set(r.sample(base, 12))
        sets[i] = [x for x in base if x not in gone] + [1000 * (i + 1) + k for k in range(12)]
    for i in range(60, 70):  # and ten that link with one of them each
        sets[i] = [*sets[i - 40][:-5], *(10**6 + 10 * i + k for k in range(5))]
    sets[70], sets[71] = [1, 2], [*range(5000, 5100)]
    rows = spark.createDataFrame([(1, i, len(x)) for i, x in sets.items()], "key long, rep long, n long")
    # a document with two sets has none that is its own alone
    table = spark.createDataFrame([*sets.items(), (71, sets[40])], "doc_id long, shingles array<long>")
    none = spark.createDataFrame([(0, 1)], "a long, b long")
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    want |= {(a, 71) for a in sets if a != 71 and 100 * len(set(sets[a]) & set(sets[40])) >= 85 * len(set(sets[a]) | set(sets[40]))}
    want -= {(0, 1)}
    found = minhash._rest(rows, none, table, 85)
    assert len(want) > 10 and {(x.a, x.b) for x in found.collect()} == want


def test_near_copies_sends_whole_rows_once(spark):
    """The kept rows are grouped where the join has put them; no exchange lies above it."""
    import corpus_pipeline

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words than those above"), (2, "A b c d e f g"), (None, "x y z"), (None, "x y z"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_copies(spark, docs, "")
        above = out._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
        assert "Exchange" not in above
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(1, "a b c d e f g"), (1, "other words than those above"), (None, "x y z"), (None, None), (3, None)], key=repr)
