"""Operator 11: periodic runs of words in linear time, without suffix structures or hashes.

A run is a maximal stretch whose words repeat with a smallest period. Every run has a Lyndon root
for the order of words or for its reverse, and that root is ``[i, next smaller suffix of i)``. So
two scans, one for each order, give all runs (Ellert and Fischer, ICALP 2021).

A scan goes through the words from left to right and keeps the suffixes that no later one has
undercut. Each new suffix is compared with the last of these, then with those before it, until one
is smaller. Comparisons reuse what has been matched:

* The scan remembers the matched pair that reaches furthest right, ``[l, ..)`` and ``[r, end)``. A
  comparison between two suffixes that both start within ``[r, end)`` had a counterpart within the
  left copy: its extension holds again unless it reaches ``end``, and then matching goes on from there.
* If a suffix is compared further down after it has matched ``e`` words of the suffix ``l``, the
  common extension of ``l`` and its own predecessor tells what it shares with that one; only if it is
  ``e``, too, are more words looked at.

So a word is looked at again only where the furthest match grows, and a scan takes linear time.
Words are only compared with each other; they have no numbers or hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import ship

#: a run has this many words and periods at least
LEAST, PERIODS = 6, 4


def _matched(w: list, a: int, b: int) -> int:
    """How many words are equal from ``a`` and ``b > a`` on."""
    n, start = len(w), b
    for _ in range(8):
        if b == n or w[a] != w[b]:
            return b - start
        a, b = a + 1, b + 1
    step = 16
    while b < n and w[a : a + min(step, n - b)] == w[b : b + step]:
        a, b, step = a + step, b + step, step * 2
    if b >= n:
        return n - start
    # unequal words are within the next ``step`` ones
    while step > 1:
        step //= 2
        if b < n and w[a : a + min(step, n - b)] == w[b : b + step]:
            a, b = a + step, b + step
    return min(b, n) - start


def roots(w: list, rising: bool, periods: float) -> list[tuple[int, int, int]]:
    """``(i, j, e)``: j begins the next suffix smaller than that of i (in the reverse order if not ``rising``), both share e words, and e is at least what the leftmost root of a run of ``periods`` has."""
    n, found = len(w), []
    after, ahead = [n] * n, [0] * n  # next smaller suffix, words shared with it
    before, behind = [-1] * n, [0] * n  # previous smaller suffix, words shared with it
    end = lag = 0
    least = periods - 2
    for r in range(1, n):
        mine, left, e = w[r], r - 1, -1
        while left >= 0:
            if e < 0:
                if r >= end:
                    other = w[left]
                    if other != mine:  # by far the most frequent case
                        if (other < mine) is rising:
                            before[r] = left
                            break
                        after[left] = r
                        left = before[left]
                        continue
                    e = _matched(w, left, r)
                else:
                    a, b = left - lag, r - lag
                    larger = after[a] == b
                    copied = ahead[a] if larger else behind[b]
                    if r + copied < end:
                        if not larger:
                            before[r], behind[r] = left, copied
                            break
                        after[left], ahead[left] = r, copied
                        if copied > least * (r - left):
                            found.append((left, r, copied))
                        left = before[left]
                        continue
                    e = end - r + _matched(w, left + end - r, end)
            else:
                e += _matched(w, left + e, r + e)
            # the words after e differ, or the text ends: this match reaches furthest
            lag, end = r - left, r + e
            if end < n and (w[left + e] < w[end]) is rising:
                before[r], behind[r] = left, e
                break
            while True:
                after[left], ahead[left] = r, e
                if e > least * (r - left):
                    found.append((left, r, e))
                shared, left = behind[left], before[left]
                if left < 0 or shared <= e:
                    break
            if left >= 0 and shared < e:
                before[r], behind[r] = left, shared
                break
    return [(i, j, e) for i, j, e in found if not (2 * i >= j and after[2 * i - j] == i and ahead[2 * i - j] >= j - i)]


def runs(words: list, least: int = LEAST, periods: float = PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` words and ``periods`` periods (2 or more), by start, then period. Words need an order only."""
    found = set()
    for rising in (True, False):
        for i, j, e in roots(words, rising, periods):
            # i is the leftmost root, so fewer words than a period are equal to its left
            k, p = i, j - i
            while k and words[k - 1] == words[k - 1 + p]:
                k -= 1
            length = j + e - k
            if length >= max(least, periods * p):
                found.add((k, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words but those that any run contains after its first period."""
    if not found:
        return words
    kept, at = [], 0
    for start, stop in sorted((s + p, s + n) for s, n, p in found):
        if start > at:
            kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:]


def repeated(words: list, doc_id: int | None) -> list:
    """The words of the query's text: those of one document in ten repeat from a place on, by the checksum of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _words(batch: pa.RecordBatch, planted: bool):
    """Each row's id and words: ``bytes.split`` cuts at the six ASCII white space characters, so one text is in Python at a time."""
    ids, texts = batch["doc_id"].to_pylist(), batch["text"]
    for k, doc_id in enumerate(ids):
        text = texts[k].as_py()
        words = (text or "").encode().split()
        yield doc_id, repeated(words, doc_id) if planted else words


def find_runs(docs: DataFrame, least: int = LEAST, periods: float = PERIODS, planted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_words, runs, collapsed``.

    ``runs`` has all runs of the whole text of at least ``least`` words and ``periods`` periods, by start,
    then period; ``collapsed`` is the text without the repetitions, words joined by one space. Words are
    ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words, no runs and an empty text. Rows are
    treated alone, so ties and repeated rows give equal rows, a null doc_id stays null, and an empty
    table gives none. Other columns are ignored. ``planted`` puts the query's repetitions in first.
    """

    def one(batches):
        for batch in batches:
            for some in _slices(batch):
                out = {"doc_id": some["doc_id"], "n_words": [], "runs": [], "collapsed": []}
                for _, words in _words(some, planted):
                    found = runs(words, least, periods)
                    out["n_words"].append(len(words))
                    out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    out["collapsed"].append(b" ".join(collapsed(words, found)).decode())
                yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["runs"], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(out["collapsed"], pa.string())], names=list(out))

    ship(docs.sparkSession)
    return _input(docs).mapInArrow(one, RUNS)


def digest_runs(docs: DataFrame, least: int = LEAST, periods: float = PERIODS, planted: bool = False) -> DataFrame:
    """As :func:`find_runs`, with the longest run (ties: smallest start, then period; four nulls without a run) and SHA-256 digests of all runs' lines and of the collapsed text instead of both."""

    def one(batches):
        for batch in batches:
            rows = []
            for doc_id, words in _words(batch, planted):
                found = runs(words, least, periods)
                s, n, p = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
                rows.append((doc_id, len(found), s, n, p, 1000 * n // p if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    ship(docs.sparkSession)
    return _input(docs).mapInArrow(one, DIGEST)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _slices(batch: pa.RecordBatch, limit: int = 4 << 20):
    """Rows of about ``limit`` bytes of text at a time, as the results hold texts again."""
    i, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch["text"]).fill_null(0).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(i, k - i)
            i, size = k, 0
        size += n
    if i < batch.num_rows:
        yield batch.slice(i)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, one in ten with its words repeated."""
    return digest_runs(table(spark, sf_dir, "documents", "doc_id", "text"), planted=True)
