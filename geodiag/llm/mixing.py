"""Operator 6 [native]: mix sources to target weights by systematic sampling.

A source's documents are ordered by size, each expects ``target / source size`` copies, and the
prefix sum of these plus one random offset for the source passes whole numbers; a document
is emitted once for each that it crosses. Order by size stratifies the sample, so that
the words taken miss a target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.llm.ranks import ranked
from geodiag.llm.tables import table
from geodiag.runtime import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: words are runs of anything but these
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 if null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target``: targets share all sizes by weight, none above ``cap`` times its source.

    Sources come by code point, null last, with the weights repeating. A level L gives each
    source min(L * weight, cap * size); it's found by fixing the sources that reach their cap
    and sharing the rest again, each time as one aggregate with two numbers, until no source
    is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = ranked(per, [], [F.col("source").asc_nulls_last()], "__n")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__n") % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", w.alias("__w"))
    total = float(named.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while total:
        full = F.col("__w") * level >= F.col("source_size") * cap if level else F.lit(False)
        fixed, free = named.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("__w")))).first()
        if not free:
            break
        new = (total - (fixed or 0.0)) / free
        if new <= level * (1 + 1e-15):
            break
        level = new
    return named.select("source", "source_size", F.least(F.col("__w") * F.lit(level), F.col("source_size") * cap).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) from the source's name and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def copies(sized: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sized`` (doc_id, source, size and any others) plus ``source_size, target, copies``."""
    numbered = ranked(sized, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last()], "__rank")
    targets = materialize(source_targets(numbered.select("source", "size"), weights, cap).withColumnRenamed("source", "__source"), "targets")
    joined = numbered.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    crossed = F.floor((F.col("__rank") + 1) * rate + u) - F.floor(F.col("__rank") * rate + u)
    return joined.withColumn("copies", crossed.cast("long")).drop("__rank")


NEW = ("size", "source_size", "target", "copies")


def _copied(docs: DataFrame, seed: int, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``row`` and the columns of :data:`NEW`."""
    return copies(docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")), seed, weights, cap).select("row", *NEW)


def with_copies(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) plus ``size, source_size, target, copies``.

    Copies depend on source, size and doc_id alone, so reruns agree. Null text has size 0, a
    null source is a source of its own. Documents without words take part like others. Rows
    alike in source, size and doc_id are interchangeable. An empty table stays empty. Columns
    of these four names in the input are replaced, all others pass, whatever their names.
    """
    return _copied(docs, seed, weights, cap).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in NEW), *NEW)


def mix(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mixture itself: ``docs`` with each row repeated ``copies`` times; all its columns pass."""
    out = _copied(docs, seed, weights, cap).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; only sizes are sorted, texts stay where they are."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    out = copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP6_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w from s),
o as (
  select *, source_size * 3e0 as most, sum(source_size) over () * 1e0 as total,
    coalesce(sum(source_size * 3e0) over (order by source_size * 3e0 / w, source rows between unbounded preceding and 1 preceding), 0e0) as fixed,
    sum(w) over (order by source_size * 3e0 / w, source rows between current row and unbounded following) as free
  from w),
l as (select min_by((total - fixed) / free, most / w) filter (where (total - fixed) / free * w <= most) as level from o),
t as (select source, source_size, least(w * level, most) as target from o, l),
r as (
  select d.doc_id, d.size, t.source_size, t.target, row_number() over (partition by d.source order by d.size desc, d.doc_id) - 1 as k,
    case when t.source_size > 0 then t.target / t.source_size else 0e0 end as rate,
    cast(cast('0x' || substr(md5('1:' || coalesce('s' || d.source, 'null')), 1, 12) as bigint) as double) / 281474976710656e0 as u
  from d join t on d.source is not distinct from t.source),
c as (select *, cast(floor((k + 1) * rate + u) - floor(k * rate + u) as bigint) as copies from r)
select doc_id, size, source_size, target, copies * size as taken, copies from c
"""
