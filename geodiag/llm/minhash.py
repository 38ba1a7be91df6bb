"""Operator 5: near-duplicate documents by one-permutation MinHash.

Each text's shingles are hashed once; the top bits of a hash choose its bin and the bin keeps
its smallest hash. Empty bins copy another bin, found by probing bins in an order that depends
on the bin and the attempt only (optimal densification), so that two texts agree in a bin with
the probability of their Jaccard similarity. Bands of bins are bucket keys.

Texts with equal shingle sets are one class. In each bucket, candidate edges form a star around
the class with the most bucket fellows, and further stars around other members join what is
still apart, until a round links nothing new; so a bucket of m classes gives O(m) pairs in a
round. At last, classes outside of their bucket's largest component meet all of the bucket that are
in other components, so that no pair of different components is left out: those with too many shingles of
their own for any link go first, the others are compared in blocks. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.llm.components import connected_components
from geodiag.llm.tables import table
from geodiag.llm.words import CHUNK, SPACED, U64, chunks, hash_spans, mix, shingles, text_buffer, word_spans
from geodiag.runtime import discard, materialize, ship

BINS = 256
_SHIFT = U64(64 - 8)
#: chance to miss a pair at the threshold itself
MISS = 1e-5
#: classes of each side of a block in which all pairs are compared
BLOCK = 256


def plan_bands(percent: int) -> tuple[int, int]:
    """Bands and rows that use the bins: the most rows, so the fewest chance meets, with which no more than :data:`MISS` is missed."""
    s = percent / 100
    for rows in range(16, 1, -1):
        bands = BINS // rows
        if (1 - s**rows) ** bands <= MISS:
            return bands, rows
    return BINS, 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a buffer, sorted by document and hash; where each document's begin."""
    starts, stops, doc = word_spans(buf, off, SPACED)
    x, d = shingles(hash_spans(buf, starts, stops), doc, len(off) - 1, k)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[first], d[first]
    return x, np.searchsorted(d, np.arange(len(off)))


def densify(sig: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row from a probed bin that isn't empty."""
    n, bins = sig.shape
    rows, cols = np.nonzero(~full & full.any(1)[:, None])
    out, attempt = sig.copy(), 1
    while len(rows):
        probe = (mix(cols.astype(U64) * U64(0x100000001B3) + U64(attempt)) >> _SHIFT).astype(np.int64) % bins
        hit = full[rows, probe]
        out[rows[hit], cols[hit]] = mix(sig[rows[hit], probe[hit]] + U64(attempt * 0xA24BAED4963EE407 % 2**64))
        rows, cols, attempt = rows[~hit], cols[~hit], attempt + 1
    return out


def band_keys(x: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys (documents x bands) of sorted shingle sets."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    cell = doc * BINS + (x >> _SHIFT).astype(np.int64)
    lead = np.ones(len(x), bool)
    lead[1:] = cell[1:] != cell[:-1]
    sig, full = np.zeros(n * BINS, U64), np.zeros(n * BINS, bool)
    sig[cell[lead]], full[cell[lead]] = x[lead], True
    sig = densify(sig.reshape(n, BINS), full.reshape(n, BINS))[:, : bands * rows].reshape(n, bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for r in range(rows):
        keys = mix(keys * U64(5) + sig[:, :, r])
    return keys.view(np.int64)


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, keys``: the two set hashes tell equal sets."""
    ship(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            buf, off = text_buffer(batch["text"])
            for i, j in chunks(off):
                x, begin = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(begin)
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(x + U64(1)))])
                other = np.concatenate([np.zeros(1, U64), np.cumsum(mix(x ^ U64(0xD1B54A32D192ED03)) * U64(3))])
                keys = band_keys(x, begin, bands, rows)[n > 0].ravel()
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(n), *(pa.array((t[begin[1:]] - t[begin[:-1]]).view(np.int64)) for t in (total, other)), _lists(keys, at)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles``: all distinct shingle hashes."""

    def collect(batches):
        for batch in batches:
            buf, off = text_buffer(batch["text"])
            for i, j in chunks(off):
                x, begin = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), _lists(x.view(np.int64), begin)], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(collect, "doc_id long, shingles array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id, kept``.

    Texts are linked if 100 * intersection >= percent * union of their sets of distinct
    ``k``-word shingles (fewer words: the whole sequence as one). Null, empty and wordless texts
    have no shingles and link with nothing. A component is named by its smallest doc_id, the
    row kept; of rows with one doc_id all or none are kept. A null doc_id is linked with
    nothing and kept. An empty table gives an empty result; other columns are ignored.
    """
    bands, rows = plan_bands(percent)
    signed = materialize(signatures(docs, k, bands, rows), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")
    # unequal sets that reach the threshold have this many elements at least
    small = int(np.ceil(percent / (100 - percent) - 1e-9)) if percent < 100 else 1 << 60
    spread = classes.where(F.col("n_shingles") >= small).select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("fellows")).where("fellows > 1")
    members = materialize(spread.join(sizes, "key"), "fellows")
    degree = members.groupBy("rep").agg(F.sum("fellows").alias("degree"))
    members_d = materialize(members.join(degree, "rep").select("key", "rep", "n", "degree"), "members")
    discard(members)
    # merged at every size: which documents are asked for grows with the corpus
    asked = members_d.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    sets = docs.select(F.col("doc_id").cast("long"), "text").join(asked, "doc_id", "left_semi")
    sets = materialize(full_sets(sets, k), "sets")
    links = _star_links(members_d, sets, percent)
    discard(members_d)
    discard(sets)
    # documents of one set are one class: its smallest doc_id stands for it
    found = connected_components(links)
    labels = classes.join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", *same).join(labels, same, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, merge: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. ``merge``: pairs are many, so they aren't broadcast."""
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.distinct().join(sa.hint("merge") if merge else sa, "a").join(sb.hint("merge") if merge else sb, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return joined.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that join all that any pairs of the buckets join."""
    near = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def star(rows: DataFrame, centres: DataFrame, apart) -> DataFrame:
        return rows.join(centres, "key").where(apart & near(F.col("n"), F.col("c.n"))).select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"))

    top = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "rep", "n")).alias("c"))
    links = materialize(_confirmed(star(members, top, F.col("rep") != F.col("c.rep")), sets, percent, merge=True), "links")
    turn = 0
    while not links.isEmpty():
        turn += 1
        found = connected_components(links)
        held = members.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "degree", F.coalesce("component", "rep").alias("comp"))
        held = materialize(held, "held")
        main = held.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "comp")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        open_ = materialize(held.join(main, "key").select("key", "rep", "n", "degree", "comp", F.col("m.comp").alias("main")), "open")
        discard(held)
        lot = F.struct(F.xxhash64("rep", F.lit(turn)).alias("lot"), "rep", "n", "comp")
        inner = open_.where("comp = main").groupBy("key").agg(F.max(lot).alias("c"))
        outer = open_.where("comp <> main").groupBy("key").agg(F.max(F.struct(F.when(F.lit(turn == 1), F.col("degree")).otherwise(F.xxhash64("rep", F.lit(turn))).alias("lot"), "rep", "n", "comp")).alias("c"))
        loose = open_.where("comp <> main")
        pairs = star(loose, inner, F.lit(True)).unionByName(star(loose, outer, F.col("comp") != F.col("c.comp")))
        new = materialize(_confirmed(pairs, sets, percent), "more")
        discard(open_)
        if new.isEmpty():
            break
        grown = materialize(links.unionByName(new).distinct(), "links")
        discard(links)
        discard(new)
        links = grown
    return links.unionByName(materialize(_rest(members, links, sets, percent), "rest"))


def _own(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, own``: how many of its shingles no other of ``reps`` has; those with several sets have no row."""
    once = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times = 1").select(F.col("doc_id").alias("rep"))
    # 32 bits tell a shingle: two that fall together count as shared, which only makes ``own`` smaller
    words = sets.join(reps, F.col("doc_id") == F.col("rep")).select("rep", F.explode("shingles").alias("shingle")).select("rep", F.hash("shingle").alias("half"))
    alone = words.groupBy("half").agg(F.count(F.lit(1)).alias("times"), F.min("rep").alias("rep")).where("times = 1")
    return alone.groupBy("rep").agg(F.count(F.lit(1)).alias("own")).join(once, "rep")


def _rest(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between pairs of one bucket in different components, but for those within the bucket's largest one.

    A class shares with another at most the shingles that aren't its own alone. Where that is too few for the
    smallest set of the bucket, it has no link there and goes. The others of a bucket are dealt to blocks, of
    :data:`BLOCK` classes outside of the largest component by :data:`BLOCK` of all, and compared in them, so that rows grow
    with a bucket's classes times its blocks and a task holds one block.
    """
    held = members.join(connected_components(links), F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    held = materialize(held, "held")
    main = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).groupBy("key").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.min("least").alias("least")).where("comps > 1")
    open_ = materialize(held.join(main, "key").select("key", "rep", "n", "comp", (F.col("comp") != F.col("m.comp")).alias("outer"), "least"), "open")
    discard(held)
    own = _own(open_.select("rep").distinct(), sets)
    live = open_.join(own, "rep", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    live = materialize(live.where((100 + percent) * F.col("most") >= percent * (F.col("n") + F.col("least"))).select("key", "rep", "comp", "outer", "most", (F.col("n") - F.col("most")).alias("own")), "live")
    discard(open_)
    sizes = live.groupBy("key").agg(F.ceil(F.count_if("outer") / BLOCK).cast("int").alias("down"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("across")).where("down > 0")
    lot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = live.join(sizes, "key")
    named = ["key", "rep", "comp", "outer", "own"]
    dealt = met.where("outer").select(*named, F.lit(True).alias("left"), lot(F.col("down")).alias("i"), each("across").alias("j"))
    dealt = dealt.unionByName(met.select(*named, F.lit(False).alias("left"), each("down").alias("i"), lot(F.col("across")).alias("j")))
    dealt = dealt.join(sets, F.col("rep") == F.col("doc_id")).drop("doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches):
        now, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tag = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1).tolist(), len(tag)]
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and tuple(tag[a]) != now:
                    yield _linked(pa.Table.from_batches(rows).combine_chunks(), percent)
                    rows = []
                now = tuple(tag[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            yield _linked(pa.Table.from_batches(rows).combine_chunks(), percent)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _linked(block: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of a left and a right row of a block, of different components, whose sets reach the threshold."""
    rep, comp, own = (np.asarray(block[c]).astype(np.int64) for c in ("rep", "comp", "own"))
    left, outer = (np.asarray(block[c]).astype(bool) for c in ("left", "outer"))
    lists = block["shingles"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    begin = np.cumsum(n) - n
    _, token = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    right = np.flatnonzero(~left & (n > 0))
    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(left & (n > 0)).tolist():
        # two outer classes meet once; shared are at most what isn't a set's own alone
        y = right[(comp[right] != comp[x]) & (~outer[right] | (rep[x] < rep[right]))]
        most = np.minimum(n[x] - own[x], n[y] - own[y])
        y = y[(100 + percent) * most >= percent * (n[x] + n[y])]
        if not len(y):
            continue
        has = np.zeros(int(token.max()) + 1, np.int64)
        has[token[begin[x] : begin[x] + n[x]]] = 1
        at = np.arange(n[y].sum()) + np.repeat(begin[y] - np.cumsum(n[y]) + n[y], n[y])
        both = np.add.reduceat(has[token[at]], np.cumsum(n[y]) - n[y])
        out += [(min(r, int(rep[x])), max(r, int(rep[x]))) for r in rep[y[(100 + percent) * both >= percent * (n[x] + n[y])]].tolist()]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=85)


OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, ws[i:i + 2] as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as label from documents union select e.b, r.label from r join e on r.node = e.a),
k as (select node, min(label) as component from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, k.component as component_id, k.component = d.doc_id as kept
from documents d join k on d.doc_id = k.node left join n on d.doc_id = n.doc_id
"""
