"""Operator 7 [native]: license scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the templates' positions. A match
votes for the diagonal ``place in text - place in template``; votes are aggregated by diagonal.
Neighbouring diagonals (words inserted or left out) are merged in overlapping windows of
:data:`DRIFT`, so that any alignment that drifts by no more lies whole in one of them. A window's
runs of matches are then verified: the chain of runs with the most words whose places rise in both
text and template, over a span of the text that may not be much longer than the template. Shuffled
or scattered notices have no such chain. Texts never move: only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import materialize

#: words are runs of anything but these
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrases that must stand word for word
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: fixed values: bodies and notices of public licences, in words; found if similar enough
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
    "the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
    "either version 2 1 of the license or at your option any later version": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "released under the mit license": "mit",
}
#: words of the grams that notices are found by; phrases may have two words
K = 4
#: words inserted or left out in all, at most, in one window of diagonals
DRIFT = 16
#: template rows that are broadcast at most; more are joined by a shuffle of the texts' grams
SENT = 200_000
#: share of the longer of notice and span that must be covered in order
SHARE = 0.8

FOUND = "array<struct<label:string,exact:boolean,first:bigint,last:bigint,share:double>>"


def template_grams(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``gram, votes``: all places ``(template, label, exact, n_words, at)`` of each gram; notices shorter than :data:`K` words are never found."""
    rows = []
    for i, (text, label, exact) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in notices.items()]):
        w = text.split()
        k = 2 if exact else K
        rows += [(i, label, exact, len(w), at, w[at : at + k]) for at in range(len(w) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, n_words int, at int, w array<string>")
    made = made.select(gram(F.col("w"), F.lit(0), 2, F.col("exact"), K).alias("gram"), "template", "label", "exact", "n_words", "at")
    return F.broadcast(made) if len(rows) <= SENT else made


def gram(words: Column, i: Column, short: int, is_short: Column, long: int) -> Column:
    hashed = lambda k: F.xxhash64(*(words[i + j] for j in range(k)))
    return F.when(is_short, hashed(short)).otherwise(hashed(long))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BREAKS), "")


def runs(diagonal: Column, ats: Column) -> Column:
    """Consecutive matches of a diagonal: ``at`` and ``place`` of their first word, and how many words they cover."""
    last = F.size(ats) - 1
    starts = F.filter(ats, lambda x, i: (i == 0) | (ats[i - 1] != x - 1))
    ends = F.filter(ats, lambda x, i: (i == last) | (F.get(ats, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (a + diagonal).alias("place"), (b - a + K).alias("n")))


def best_chain(segments: Column) -> Column:
    """Of chains of runs that rise in text and template, that which covers most words: ``words, first, last`` (places in the text).

    Each run goes on the best earlier one; what two runs share counts once.
    """

    def add(chains, s):
        def longer(best, c):
            gain = F.least(s["n"], s["at"] + s["n"] - c["at"], s["place"] + s["n"] - c["last"])
            rises = (s["at"] > c["begin"]) & (s["place"] > c["from"]) & (gain > 0)
            return F.when(rises & (c["words"] + gain > best["words"]), F.struct((c["words"] + gain).alias("words"), c["first"].alias("first"))).otherwise(best)

        best = F.aggregate(chains, F.struct(s["n"].alias("words"), s["place"].alias("first")), longer)
        end = F.struct(best["words"].alias("words"), best["first"].alias("first"), (s["place"] + s["n"]).alias("last"), (s["at"] + s["n"]).alias("at"), s["at"].alias("begin"), s["place"].alias("from"))
        return F.concat(chains, F.array(end))

    none = F.array().cast("array<struct<words:int,first:int,last:int,at:int,begin:int,from:int>>")
    chains = F.aggregate(F.array_sort(segments), none, add)
    # of chains with equally many words the shortest, then the first
    return F.array_max(F.transform(chains, lambda c: F.struct(c["words"].alias("words"), (c["first"] - c["last"]).alias("short"), (-c["first"]).alias("minus"), c["first"].alias("first"), c["last"].alias("last"))))


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Verified spans: doc_id, ``n_words`` and an array ``found`` of ``(label, exact, first, last, share)``.

    ``docs`` has doc_id and text; other columns are ignored. Null and empty texts have no words. A
    null doc_id is a key like any other. Repeated rows with the same doc_id and text get the same
    result each. An empty table gives none. No cap: each match votes. A window's runs are held in
    one row, as their text is.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__text"), words_of(F.col("text")).alias("w"))
    base = keyed.select("doc_id", "__text", F.size("w").cast("long").alias("n_words"))
    n, w = F.size("w"), F.col("w")
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.struct(i.alias("place"), F.xxhash64(*(w[i + j] for j in range(k))).alias("gram"))))
    both = F.concat(*(F.coalesce(grams(k), F.array().cast("array<struct<place:int,gram:bigint>>")) for k in (2, K)))
    rolled = keyed.select("doc_id", "__text", F.explode(both).alias("g")).select("doc_id", "__text", "g.place", "g.gram")
    # equal rows vote once: their spans are joined back to each
    votes = rolled.join(template_grams(spark, phrases, notices), "gram").groupBy("doc_id", "__text", "template", "label", "exact", F.col("n_words").alias("size"), (F.col("place") - F.col("at")).alias("diagonal"))
    # places are at most the template's length; written, as two plans read them and texts should be hashed once
    lines = materialize(votes.agg(F.sort_array(F.collect_set("at")).alias("ats")), "diagonals")
    key = ["doc_id", "__text"]
    whole = lines.where("exact and size(ats) = size - 1").select(*key, "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("last"), F.lit(1.0).alias("share"))
    cell = F.floor(F.col("diagonal") / DRIFT)
    near = lines.where("not exact").select(*key, "template", "label", "size", F.explode(F.array(cell, cell + 1)).alias("cell"), F.size("ats").alias("votes"), runs(F.col("diagonal"), F.col("ats")).alias("runs"))
    windows = near.groupBy(*key, "template", "label", "size", "cell").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("runs")).alias("runs"))
    # a gram covers K words, so a window with fewer votes can't reach the share
    chained = windows.where(F.col("votes") * K >= F.col("size") * SHARE).select(*key, "label", "size", F.explode(F.array(best_chain(F.col("runs")))).alias("c"))
    share = F.col("c.words") / F.greatest(F.col("size"), F.col("c.last") - F.col("c.first"))
    similar = chained.select(*key, "label", F.lit(False).alias("exact"), F.col("c.first").alias("first"), F.col("c.last").alias("last"), share.alias("share")).where(F.col("share") >= SHARE)
    span = F.struct("label", "exact", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "share")
    good = whole.unionByName(similar).groupBy(*key).agg(F.sort_array(F.collect_set(span)).alias("found"))
    same = (base["doc_id"].eqNullSafe(good["doc_id"])) & (base["__text"] == good["__text"])
    return base.join(good, same, "left").select(base["doc_id"], "n_words", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrases and notices of every document."""
    out = spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda x: x["exact"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
