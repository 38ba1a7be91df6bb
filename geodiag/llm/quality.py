"""Operator 4 [native]: quality rules with host-level verdicts.

Each text is measured within its own row: words, symbols, repeated lines and words in repeated
three-word windows, all in time n log n. Rule failures are counted by host (here: source), each
host's failure rate is shrunk towards a beta prior fitted to all hosts, and the verdict on a
host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import materialize

SPACES = r"[\x20\x09-\x0D]+"

#: names of the document-level rules, in order of the bits of ``failed``
RULES = ("short", "repeats", "symbols", "lines", "word_length", "shouting")
#: a host is rejected when its failure rate is surely above the prior's mean and three deviations, but no less than the first and no more than the second of these
HOST_LIMITS = (0.5, 0.8)
DEVIATIONS = 3.0
#: deviations of a host's own posterior that count as sure
SURE = 2.0


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that are found twice or more.

    A window's hash and its place share a long (as many low bits for the place as the text's
    length needs), so that one primitive sort brings equal windows together; neighbours are
    then compared by their whole hashes.
    """

    def count(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + F.lit(1.0))).cast("int")

        def marked(b: Column) -> Column:
            place = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
            packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long"))))

            def doubled(s: Column) -> Column:
                at = lambda k: s[k].bitwiseAND(place).cast("int")
                last = F.size(s) - 1
                same = lambda i, j: h[at(i)] == h[at(j)]
                pairs = F.filter(F.sequence(F.lit(1), last), lambda i: same(i - 1, i))
                hits = F.flatten(F.transform(pairs, lambda i: F.array(at(i - 1), at(i))))
                return _let(hits, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

            return _let(packed, doubled)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(bits, marked))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once per row."""
    return F.transform(F.array(value), f).getItem(0)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``m``, a struct of the counts; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), _repeat_words(words, n).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn(
        "m",
        _let(
            F.struct(_let(F.array_remove(F.split(text, SPACES), ""), counts).alias("w"), lines.alias("l")),
            lambda s: F.struct(
                s["w"]["n_words"].alias("n_words"),
                F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                s["w"]["n_repeat_words"].alias("n_repeat_words"),
                F.size(s["l"]).cast("long").alias("n_lines"),
                F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_shouts"),
            ),
        ),
    )


def failures(m: Column) -> Column:
    """The rules of :data:`RULES` that a text fails, as bits."""
    n = m["n_words"]
    fails = (
        n < 50,
        100 * m["n_repeat_words"] > 50 * n,
        10 * m["n_symbols"] > n,
        (m["n_dup_lines"] >= 5) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),  # a header and footer alone aren't junk
        (m["word_chars"] < 3 * n) | (m["word_chars"] > 15 * n),
        2 * m["n_shouts"] > n,
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def host_verdicts(measured: DataFrame, host: str = "source", limits: tuple[float, float] = HOST_LIMITS) -> DataFrame:
    """``host, host_docs, host_failed, strength, host_limit, host_rate, host_ok``.

    The prior is a beta distribution fitted to the hosts' rates by moments, each host counting
    once; with one host, or no more spread than chance gives, it's as strong as a thousand
    documents, so that no host stands out by chance. A host's rate is shrunk towards it, and is rejected if the posterior
    is :data:`SURE` deviations above the limit. Counts combine before the shuffle; a host is one row then.
    """
    per = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col("failed") > 0).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    stats = per.agg(F.avg(rate).alias("mu"), F.var_samp(rate).alias("var"), F.avg(1.0 / F.col("host_docs")).alias("inv"))
    noise = F.col("mu") * (1 - F.col("mu")) * F.col("inv")
    spread = F.coalesce(F.col("var"), F.lit(0.0)) - noise
    strength = F.when(spread > 1e-12, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("mu") * (1 - F.col("mu")) / spread - 1))).otherwise(1000.0)
    prior = stats.select("mu", strength.alias("strength"))
    deviation = lambda p, n: F.sqrt(p * (1 - p) / (n + 1))
    limit = F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), F.col("mu") + DEVIATIONS * deviation(F.col("mu"), F.col("strength"))))
    n = F.col("host_docs") + F.col("strength")
    shrunk = (F.col("host_failed") + F.col("mu") * F.col("strength")) / n
    # one row joins every host's row
    out = per.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", "strength", limit.alias("host_limit"), shrunk.alias("host_rate"), n.alias("n"))
    return out.select("*", (F.col("host_rate") - SURE * deviation(F.col("host_rate"), F.col("n")) <= F.col("host_limit")).alias("host_ok")).drop("n")


def _judged(docs: DataFrame, host: str, limits: tuple[float, float]) -> DataFrame:
    """``row, m, failed, host_rate, host_ok``: whole rows are one column, so that no name of theirs meets one of ours. Texts are measured once and written."""
    named = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), F.col(host).alias("of"))
    measured = materialize(measure(named).drop("text").withColumn("failed", failures(F.col("m"))), "measured")
    # written, so that the join is planned by the hosts' true size: texts aren't dealt out by host
    hosts = materialize(host_verdicts(measured, "of", limits).select("host", "host_rate", "host_ok"), "hosts")
    return measured.join(hosts, F.col("of").eqNullSafe(F.col("host"))).select("row", "m", "failed", "host_rate", "host_ok")


ADDED = ("m", "failed", "base_failed", "host_rate", "kept")


def judge(docs: DataFrame, host: str = "source", limits: tuple[float, float] = HOST_LIMITS) -> DataFrame:
    """``docs`` with ``m, failed, base_failed, host_rate, kept``.

    A document is kept if it fails no rule and its host is not rejected. Null and empty texts
    have no words and fail; a null host is a host of its own; repeated rows each get a verdict;
    an empty table gives none. Columns of these five names in the input are replaced, all others pass,
    whatever their names.
    """
    base = F.col("failed").bitwiseAND(3) > 0
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return _judged(docs, host, limits).select(*own, "m", "failed", base.alias("base_failed"), "host_rate", ((F.col("failed") == 0) & F.col("host_ok")).alias("kept"))


def accepted(docs: DataFrame, host: str = "source", limits: tuple[float, float] = HOST_LIMITS) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns only."""
    return _judged(docs, host, limits).where((F.col("failed") == 0) & F.col("host_ok")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    measured = materialize(measure(docs).select("doc_id", "source", "m", failures(F.col("m")).alias("failed")), "quality")
    hosts = materialize(host_verdicts(measured), "hosts")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return joined.select(
        "doc_id", *(F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (F.col("failed").bitwiseAND(3) > 0).alias("base_failed"), ((F.col("failed") == 0) & F.col("host_ok")).alias("kept"), F.col("failed").cast("int").alias("failed_rules"),
    )


OP4_SQL = r"""
with t as (select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
i as (select k, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select k, i, count(*) over (partition by k, ws[i], ws[i + 1], ws[i + 2]) as c from i),
rw as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from g where c > 1) group by k),
m as (
  select w.k, doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    coalesce(rw.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) as n_shouts
  from w left join rw on w.k = rw.k),
f as (
  select *, cast((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines)::int
    + 16 * (word_chars < 3 * n_words or word_chars > 15 * n_words)::int + 32 * (2 * n_shouts > n_words)::int as integer) as failed from m),
h as (select source, count(*) as n, count(*) filter (where failed > 0) as bad from f group by source),
s as (select avg(bad / n) as mu, coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1e0 / n) as spread from h),
p as (select mu, case when spread > 1e-12 then greatest(1e0, least(1e3, mu * (1 - mu) / spread - 1)) else 1e3 end as strength from s),
r as (select source, n + strength as k, (bad + mu * strength) / (n + strength) as rate, least(0.8e0, greatest(0.5e0, mu + 3 * sqrt(mu * (1 - mu) / (strength + 1)))) as most from h, p),
v as (select source, rate - 2 * sqrt(rate * (1 - rate) / (k + 1)) <= most as ok from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 > 0 as base_failed, failed = 0 and ok as kept, failed as failed_rules
from f join v on f.source is not distinct from v.source
"""
