"""Operator 13: how five document filters interact, in all orders of application.

Which filters a document fails doesn't depend on the order. So each document gets a mask of five
bits, and all reports come from counts of masks. Four bits are native measures of the text. The fifth,
identical to the text of a smaller doc_id, needs all texts: rows are routed by the 64-bit xxhash of
their text, and tasks keep chains of the texts that share a fingerprint, each whole and with its
smallest id; all other ids are emitted.

Each map task keeps such chains first and routes a text once, so a text with very many copies is
as many rows in the task that has its fingerprint as there are map tasks. Ids emitted there travel
along without texts, dealt out evenly. Chains let go of their texts when they hold ``HELD`` bytes; that
only routes a text more often. Masks, with what the labels say of their documents, are merged to a
vector of counts for each part with ``combineByKey``, and the vectors, of a fixed length, give the
600 rows of a part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import parallelism, ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: bytes of text that the chains of a map task hold
HELD = 32 << 20
#: ids that it collects rows of before it emits them
EMITTED = 1 << 16
#: bytes of text that are routed to one task in the mean
SHARE = 64 << 20
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    # once for each row, as the words are used three times
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < 200, 1).otherwise(0)
        .bitwiseOR(F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0))
        .bitwiseOR(F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0))
        .bitwiseOR(F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)),
    )[0]


class Chains:
    """Texts by fingerprint: whole, with the smallest id and how many of its rows there are by part and mask. Texts that share a fingerprint are a chain."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def offer(self, key: int, text: str, doc_id: int, counts: dict) -> tuple[int, dict] | None:
        """Take an id's rows. Of them and those held for their text, return those without the smallest id, or None for a new text.

        Rows with one id don't repeat each other: the id's rows are all held.
        """
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    _sum(entry[2], counts)
                    return None
                if doc_id > entry[1]:
                    return doc_id, counts
                out, entry[1], entry[2] = (entry[1], entry[2]), doc_id, dict(counts)
                return out
        chain.append([text, doc_id, dict(counts)])
        self.held += len(text)
        return None

    def drain(self) -> Iterator[tuple[int, list]]:
        """All entries with their fingerprints; none is held afterwards."""
        chains, self.chains, self.held = self.chains, {}, 0
        for key, chain in chains.items():
            for entry in chain:
                yield key, entry


def _sum(into: dict, counts: dict) -> None:
    for k, n in counts.items():
        into[k] = into.get(k, 0) + n


def _map_side(rows) -> Iterator[tuple[int, tuple]]:
    """Routed entries ``(fingerprint, (text, id, counts))``; ids that a smaller one repeats, and those that are null, without text."""
    chains, without = Chains(), {}

    def emitted():
        for doc_id, counts in without.items():
            yield (0 if doc_id is None else doc_id * 0x9E3779B97F4A7C15 >> 24), (None, doc_id, counts)
        without.clear()

    for key, doc_id, text, part, mask in rows:
        out = (None, {(part, mask): 1}) if doc_id is None else chains.offer(key, text, doc_id, {(part, mask): 1})
        if out is not None:
            _sum(without.setdefault(out[0], {}), out[1])
        if len(without) > EMITTED:
            yield from emitted()
        if chains.held > HELD:
            yield from ((k, tuple(entry)) for k, entry in chains.drain())
    yield from emitted()
    yield from ((k, tuple(entry)) for k, entry in chains.drain())


def _reduce_side(routed) -> Iterator[tuple[int | None, str, int, int]]:
    """``(id, part, mask, n)``, with the fifth bit for rows whose text a smaller id has."""

    def rows(doc_id, counts, bit):
        for (part, mask), n in counts.items():
            yield doc_id, part, mask | bit, n

    chains = Chains()
    for key, (text, doc_id, counts) in routed:
        if text is None:
            yield from rows(doc_id, counts, 0 if doc_id is None else COPY)
        elif (out := chains.offer(key, text, doc_id, counts)) is not None:
            yield from rows(*out, COPY)
    for _, (_, doc_id, counts) in chains.drain():
        yield from rows(doc_id, counts, 0)


def _route(key: int) -> int:
    return key


def masks(docs: DataFrame, partitions: int | None = None) -> RDD:
    """``(doc_id, part, mask, n)``: how many rows of ``docs`` (doc_id, text, lang) there are of each kind, some of them in several rows. Texts are measured first: tasks that hold chains are as many as their bytes ask for, and as shuffle partitions at least."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        partitions = max(parallelism(docs.sparkSession), -(-size // SHARE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = rows.select(F.xxhash64("text").alias("key"), "doc_id", "text", "part", failures(F.col("text")).alias("mask"))
    routed = rows.rdd.mapPartitions(_map_side)
    return routed.partitionBy(partitions, _route).mapPartitions(_reduce_side)


def repeated_ids(docs: DataFrame) -> RDD:
    """Ids whose text a smaller id has, too; an id with several such rows may come several times."""
    return masks(docs).filter(lambda r: r[2] & COPY).map(lambda r: r[0])


#: of each mask: documents, those labelled good, those labelled toxic
KINDS = 3


def _one(cell: tuple) -> np.ndarray:
    return _add(np.zeros((1 << len(FILTERS), KINDS), np.int64), cell)


def _add(vector: np.ndarray, cell: tuple) -> np.ndarray:
    mask, n, good, toxic = cell
    vector[mask] += (n, n * good, n * toxic)
    return vector


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def report(part: str, vector: np.ndarray) -> list[Row]:
    """The rows of a part: 120 orders of five steps each."""
    bits = np.arange(len(vector))
    fails = [(bits >> f & 1).astype(bool) for f in range(len(FILTERS))]
    total = vector[:, 0]
    unique = [int(total[1 << f]) for f in range(len(FILTERS))]
    steps, shapley = [], [0] * len(FILTERS)
    for order in ORDERS:
        left = np.ones(len(vector), bool)
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            gone = left & fails[f]
            again = fails[f] & ~left
            left = left & ~fails[f]
            removed, good, toxic = (int(x) for x in vector[gone].sum(axis=0))
            shapley[f] += removed
            steps.append((order, step, f, int(total[left].sum()), removed, int(total[again].sum()), good, toxic))
    return [Row(part, o, s, kept, removed, redundant, unique[f], good, toxic, shapley[f]) for o, s, f, kept, removed, redundant, good, toxic in steps]


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows for each value of ``lang`` (null: empty) of ``docs`` (doc_id, text, lang): what each filter removes at each step of each order.

    ``labels`` (doc_id, quality, toxic) says which documents are good (quality 1) or toxic (toxic 1); a document with several rows
    there is what any of them says, one without is neither. Null texts are empty, and empty ones fail A alone, as a share of nothing
    isn't exceeded, and E if a smaller id has an empty text, too. Rows without doc_id have no labels and repeat nothing. Repeated rows
    count as often as they are there, and rows with one doc_id don't repeat each other. An empty table gives no parts. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    # texts are left behind before rows meet their labels
    found = spark.createDataFrame(masks(docs), "doc_id long, part string, mask int, n long", verifySchema=False)
    found = found.join(known, F.col("doc_id") == F.col("id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    vectors = found.rdd.map(lambda r: (r[0], r[1:])).combineByKey(_one, _add, _merge)
    return spark.createDataFrame(vectors.flatMap(lambda x: report(*x)), REPORT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents and labels."""
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP13_SQL = r"""
with words as (
    select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), least as (
    select coalesce(text, '') as text, min(doc_id) as first from documents group by 1
), known as (
    select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by 1
), masks as (
    select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
        (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
        + (case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 4 else 0 end)
        + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first then 16 else 0 end) as mask
    from words join least using (text) left join known using (doc_id)
), counted as (
    select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from masks group by 1, 2
), filters as (select i, chr(65 + i) as letter, 1 << i as bit from (select unnest(range(5))::int as i)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from filters a, filters b, filters c, filters d, filters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
    select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as gone from orders, (select unnest(range(1, 6))::int as s)
), rows as (
    select part, filter_order, step, bit,
        sum(case when mask & (gone | bit) = 0 then n else 0 end) as kept, sum(case when mask & gone = 0 and mask & bit <> 0 then n else 0 end) as removed,
        sum(case when mask & gone <> 0 and mask & bit <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
        sum(case when mask & gone = 0 and mask & bit <> 0 then good else 0 end) as good_lost, sum(case when mask & gone = 0 and mask & bit <> 0 then bad else 0 end) as toxic_lost
    from steps, counted group by 1, 2, 3, 4
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from rows
"""
