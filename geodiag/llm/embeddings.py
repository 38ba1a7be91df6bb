"""Operator 3: near-duplicate embeddings by random-hyperplane sign hashing.

Several tables of sign bits deal the vectors into buckets; in a bucket every pair is verified
by its cosine in double precision. A pair that shares several tables' buckets counts in the
first of them only, so links are counted exactly once and no pair is ever emitted: a bucket
yields one count per vector and the edges of a spanning forest. Equal vectors are one class
with a multiplicity. A bucket of more than a block of vectors is split into pairs of blocks,
which different tasks take.

Bits per table follow the logarithm of the number of vectors, so that chance meets stay at
about ``FELLOWS`` a bucket; the number of tables then follows from the recall asked for at the
threshold itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.llm.components import connected_components
from geodiag.runtime import materialize, ship

FELLOWS = 24
MISS = 1e-4
BLOCK = 1024
SEED = 77


def plan_tables(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors: a pair at the threshold is missed with probability ``miss`` at most."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / FELLOWS + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def matrix(col) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a double matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # else squares of tiny or huge components under- or overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def planes(dim: int, bits: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, bits, table]).standard_normal((dim, bits))


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links of a block pair join: each vector to the smallest label seen, again until nothing moves."""
    i, j = np.nonzero(link)
    if not len(i):
        return []
    nodes, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(len(nodes)))]


COUNTED = "u long, v long, links long"


def link_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine of ``cosine`` or more that share a bucket;
    no link below it is made. Vectors that are null, empty or zero or hold a null or non-finite
    component link with nothing; vectors of different lengths never link; a null vec_id links
    with nothing. Rows with one vec_id are one vector in components and separate rows in counts.
    An empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats; all sums are of doubles
    e = F.col("embedding").cast(kind)
    clean = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(clean, e).alias("e"))
    classes = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.withColumn("dim", F.size("e")), "vectors")
    n = classes.count()
    bits, tables = plan_tables(n, cosine, miss)

    def keys(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for d in np.unique(dims):
                rows_d = np.flatnonzero(dims == d)
                part = batch.take(pa.array(rows_d))
                if d not in made:
                    made[d] = np.concatenate([planes(int(d), bits, t) for t in range(tables)], axis=1)
                for s in range(0, len(rows_d), 2048):
                    sub = part.slice(s, 2048)
                    signs = (_unit(matrix(sub["e"])) @ made[d] >= 0).reshape(sub.num_rows, tables, bits)
                    key = (signs << np.arange(bits)).sum(axis=2).astype(np.int32)
                    begin = np.arange(0, sub.num_rows * tables + 1, tables, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([sub["rep"], sub["weight"], sub["dim"], sub["e"], pa.ListArray.from_arrays(pa.array(begin), pa.array(key.ravel()))], names=["rep", "weight", "dim", "e", "keys"])

    hashed = materialize(classes.mapInArrow(keys, f"rep long, weight long, dim int, e {kind}, keys array<int>"), "hashed")
    rows_of = hashed.select("*", F.posexplode("keys").alias("t", "key"))
    sizes = rows_of.groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = rows_of.join(sizes, ["dim", "t", "key"])
    blocks = F.ceil(F.col("m") / float(block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), (own <= x).alias("left")))
    dealt = met.select("rep", "weight", "dim", "e", "keys", "t", "key", own.alias("own"), F.explode(cells).alias("c")).select("rep", "weight", "dim", "e", "keys", "t", "key", "own", "c.i", "c.j")
    dealt = dealt.repartition("dim", "t", "key", "i", "j").sortWithinPartitions("dim", "t", "key", "i", "j")

    def verify(batches):
        held: list[pa.RecordBatch] = []
        out: tuple[list, list, list] = ([], [], [])

        def close():
            b = pa.Table.from_batches(held).combine_chunks()
            if b.num_rows < 2:
                return
            t, i, j = b["t"][0].as_py(), b["i"][0].as_py(), b["j"][0].as_py()
            v, rep, weight = _unit(matrix(b["e"])), np.asarray(b["rep"]), np.asarray(b["weight"])
            earlier = matrix(b["keys"]).astype(np.int32)[:, :t]
            own = np.asarray(b["own"])
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for s in range(0, len(left), 512):
                a = left[s : s + 512]
                link = v[a] @ v[right].T >= cosine
                x, y = np.nonzero(link)
                ok = (rep[a[x]] < rep[right[y]]) if i == j else np.ones(len(x), bool)
                x, y = x[ok], y[ok]
                for p in range(0, len(x), 1 << 17):  # pairs that met in an earlier table count there
                    xs, ys = a[x[p : p + (1 << 17)]], right[y[p : p + (1 << 17)]]
                    new = np.ones(len(xs), bool)
                    for q in range(t):
                        new &= earlier[xs, q] != earlier[ys, q]
                    xs, ys = xs[new], ys[new]
                    count = np.bincount(xs, weight[ys], len(rep)) + np.bincount(ys, weight[xs], len(rep))
                    some = np.flatnonzero(count)
                    out[0].extend(rep[some].tolist())
                    out[1].extend(rep[some].tolist())
                    out[2].extend(count[some].astype(np.int64).tolist())
                    grid = np.zeros((len(a), len(right)), bool)
                    grid[np.searchsorted(a, xs), np.searchsorted(right, ys)] = True
                    for u, w in _forest(grid, rep[a], rep[right]):
                        out[0].append(u)
                        out[1].append(w)
                        out[2].append(0)

        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tag = np.stack([np.asarray(batch[c]) for c in ("dim", "t", "key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1).tolist(), len(tag)]
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and tuple(tag[a]) != now:
                    close()
                    held.clear()
                now = tuple(tag[a])
                held.append(batch.slice(a, b - a))
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v", "links"])
                for x in out:
                    x.clear()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v", "links"])

    found = materialize(dealt.mapInArrow(verify, COUNTED), "links")
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("u <> v"), "u", "v")
    per = hashed.select("rep", "weight", "e").join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    per = materialize(per.select("rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "e"), "per-class")
    out = rows.join(per, "e", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors at cosine 0.95."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP3_SQL = """
with recursive n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
v as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from n),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.95e0),
r as (select vec_id as node, vec_id as label from embeddings union select l.b, r.label from r join l on r.node = l.a),
c as (select node, min(label) as component from r group by node),
d as (select a, count(*) as k from l group by a)
select e.vec_id, coalesce(d.k, 0) as n_links, c.component as component_id, c.component = e.vec_id as kept
from embeddings e join c on e.vec_id = c.node left join d on e.vec_id = d.a
"""
