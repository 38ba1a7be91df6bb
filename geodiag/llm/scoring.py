"""Operator 2: marginal probability of whole texts over a subword lattice.

Pieces of an existing vocabulary spell a text in many ways, weighed by the vocabulary's own scores; the
log-space forward recursion over the lattice sums over all of them. That is ``score``. As no piece
crosses a word's end, the recursion over a text is a sum of its words' recursions. No weight comes from the documents.

Two further columns add arcs from training documents to the same lattice, over the same letters and weighed by their
counts: ``word_score`` has words seen there, ``phrase_score`` phrases as well. As no arc crosses a phrase's end, and only
phrases cross a word's end, the recursion is a sum of words in each phrase and a sum of phrases.

* pieces: ``lattice(word)``, the forward sum under the existing scores.
* words: absolute discounting takes from seen words for unseen ones,
  ``(c - D) / N + D * V / N * unseen(word)``. A word with punctuation at its end is a seen word and
  seen punctuation, or pieces: ``unseen(word) = c(stem) / N * c(tail) / N + (1 - tails / N) * lattice(word)``.
* phrases: words up to one whose hash is 0 modulo 8, such phrases up to a hash that is 0 modulo 64,
  and so on by ``LEVELS``, so equal passages are cut alike wherever they stand. A phrase of two parts
  or more is ``(1 - q) * parts + q * (c - E) / M``. How much a text quotes isn't known beforehand: its
  probability is the mean over the shares q of ``SHARES``. A training document's own uses don't count
  for its phrases, or each would quote itself.

The sum over all texts is 1 at most for each.

Documents are tokenised once, to blocks of about ``BLOCK`` bytes that are written as rows of a
table: their distinct words and phrases with uses, and a compressed payload. Uses are summed by an
aggregate and joined back to the blocks that share a word or phrase with others. So each pair of a
block and a word or phrase in it is one row, in proportion to the text; nothing is gathered on the
driver or broadcast but the vocabulary, which is of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.llm.lattice import MODEL, build, forward, load_pieces, rank_weights
from geodiag.llm.sampling import _vocabulary
from geodiag.llm.tables import table
from geodiag.llm.words import LOWER, SPACED, U64, chunks, hash_spans, mix, text_buffer, word_spans
from geodiag.runtime import discard, materialize, ship

BLOCK = 6 << 20
#: taken from each seen word's and phrase's count
DISCOUNT, PHRASE_DISCOUNT = 0.75, 0.5
#: a phrase of each level ends with one of this many words, in the mean; each is a multiple of the one before
LEVELS = (8, 64)
#: shares of quoted phrases, equally likely
SHARES = (0.02, 0.1, 0.3, 0.6, 0.9, 0.99)
#: bytes of the punctuation at a word's end
TAIL = np.isin(np.arange(256), list(b".,;:!?"))
#: low bits of hashes: words have 0, phrases their level from 1, punctuation this
TAILS = 7
#: words whose spelling a Python worker remembers
REMEMBERED = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves remainder 0 by 10; a null doc_id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Spelling:
    """Log of the lattice's sum for words; words met before aren't computed again."""

    def __init__(self, data):
        self.vocabulary, self.weights = _vocabulary(data)
        self.known, self.value = np.zeros(0, U64), np.zeros(0)

    def __call__(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Values of words with the hashes ``h``, in order, that stand at ``buf[starts:stops]``."""
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        out = np.empty(len(h))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        out[~new] = self.value[at[~new]] if len(self.known) else 0.0
        todo = np.flatnonzero(new)
        size = stops[todo] - starts[todo] + 1  # each word begins with the pieces' word mark
        off = np.concatenate([[0], np.cumsum(size)])
        for i, j in chunks(off, 1 << 17):
            n, begin = size[i:j], off[i:j] - off[i]
            flat = LOWER[buf[np.maximum(np.repeat(starts[todo[i:j]] - 1 - begin, n) + np.arange(n.sum()), 0)]]
            flat[begin] = 32
            g = build(self.vocabulary, flat, off[i : j + 1] - off[i])
            out[todo[i:j]] = forward(g, self.weights)[g.root + g.size]
        if len(todo):
            if len(self.known) + len(todo) > REMEMBERED:
                self.known, self.value = np.zeros(0, U64), np.zeros(0)
            known, value = np.concatenate([self.known, h[todo]]), np.concatenate([self.value, out[todo]])
            order = np.argsort(known)
            self.known, self.value = known[order], value[order]
        return out


def phrases(h: np.ndarray, doc: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each phrase of a run of words, and its hash; phrases end with a text."""
    end = (h >> U64(20)) % U64(every) == 0
    end[:-1] |= doc[1:] != doc[:-1]
    end[-1] = True
    first = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1])
    size = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, size)
    return first, mix(np.add.reduceat(mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15)), first) + size.astype(U64))


def nested(h: np.ndarray, doc: np.ndarray, levels: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: the first part of each phrase among those of the level below, which phrases have two parts or more, and of these the first word and the hash."""
    out, below = [], np.arange(len(h))
    for every in levels if len(h) else ():
        first, key = phrases(h, doc, every)
        part = np.searchsorted(below, first)
        many = np.diff(np.append(part, len(below))) > 1
        out.append((part, many, first[many], key[many]))
        below = first
    return out


def tails(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with something before punctuation at their end, and the hashes of both parts."""
    at = np.flatnonzero(TAIL[buf[stops - 1]]) if len(stops) else np.zeros(0, np.int64)
    cut = stops[at] - 1
    while len(more := np.flatnonzero((cut > starts[at]) & TAIL[buf[cut - 1]])):
        cut[more] -= 1
    whole = cut > starts[at]
    at, cut = at[whole], cut[whole]
    return at, hash_spans(buf, starts[at], cut), hash_spans(buf, cut, stops[at])


BLOCKS = "block long, n_train long, hash array<long>, uses array<int>, payload binary"


def _rows(**lists) -> bytes:
    """Arrays of any lengths as a compressed table of one row."""
    kept = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in lists.items()}
    batch, sink = pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _planes(x: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers as three tables of bytes, which compress better."""
    return {f"word{k}": (x >> shift & most).astype(t) for k, (shift, most, t) in enumerate(((0, 255, np.uint8), (8, 255, np.uint8), (16, 0x7FFF, np.uint16)))}


def _parts(levelled: list, unit: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """A block's phrases by level, for its payload: how many parts each has, and the units of those with two or more."""
    out, at = {}, 0
    for q, (part, _, first, _) in enumerate(levelled):
        out |= {f"parts{q}": np.diff(np.append(part, n)).astype(np.int32), f"phrase{q}": unit[at : at + len(first)]}
        n, at = len(part), at + len(first)
    return out


def blocks_of(docs: DataFrame, data, levels: tuple[int, ...], limit: int) -> DataFrame:
    """Blocks of documents (doc_id, text, held_out): hashes of distinct words and phrases, in order, and their uses by training documents."""

    def tokenise(batches):
        from pyspark import TaskContext

        spell, number = Spelling(data), TaskContext.get().partitionId() << 32
        for batch in batches:
            text, off_all = text_buffer(batch["text"])
            train_all = ~np.asarray(batch["held_out"])
            for i, j in chunks(off_all, limit):
                buf, off, train = text[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i], train_all[i:j]
                word, doc, starts, stops = [], [], [], []
                for a, b in chunks(off):
                    s, e, d = word_spans(buf[off[a] : off[b]], off[a : b + 1] - off[a], SPACED)
                    word.append(hash_spans(buf[off[a] : off[b]], s, e))
                    starts.append(s + off[a])
                    stops.append(e + off[a])
                    doc.append(d + a)
                h, doc, starts, stops = (np.concatenate(x) for x in (word, doc, starts, stops))
                n, levelled = len(h), nested(h, doc, levels)
                tailed, stem, tail = tails(buf, starts, stops)
                # the low bits tell a hash's level
                keys = [h, *(x[3] for x in levelled), stem, tail]
                level = [0, *range(1, len(levelled) + 1), 0, TAILS]
                u, lead, unit = np.unique(np.concatenate([k & ~U64(7) | U64(q) for q, k in zip(level, keys)]), return_index=True, return_inverse=True)
                counts = np.concatenate([train[doc], *(train[doc[x[2]]] for x in levelled), np.zeros(len(stem), bool), train[doc[tailed]]])
                uses = np.bincount(unit[counts], minlength=len(u)).astype(np.int32)
                words = np.flatnonzero(lead < n)
                spelt = np.zeros(len(u), np.float32)
                spelt[words] = spell(u[words], buf, starts[lead[words]], stops[lead[words]])
                # frequent words first, so that their numbers are small
                order = np.argsort(-np.bincount(unit[:n], minlength=len(u)), kind="stable")
                u, uses, spelt, place = u[order], uses[order], spelt[order], np.empty(len(u), np.int32)
                place[order] = np.arange(len(u), dtype=np.int32)
                unit = place[unit]
                at = len(unit) - 2 * len(stem)
                _, some = np.unique(unit[tailed], return_index=True)
                payload = _rows(
                    doc_id=batch["doc_id"].slice(i, j - i), train=train, size=np.bincount(doc, minlength=j - i).astype(np.int32), spelt=spelt[: len(words)], **_planes(unit[:n]),
                    tailed=unit[tailed[some]], stem=unit[at:][some], tail=unit[at + len(stem) :][some], **_parts(levelled, unit[n:at], n),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([int(train.sum())]), pa.ListArray.from_arrays(pa.array([0, len(u)], pa.int32()), pa.array(u.view(np.int64))), pa.ListArray.from_arrays(pa.array([0, len(u)], pa.int32()), pa.array(uses)), pa.array([payload], pa.binary())],
                    names=[c.split()[0] for c in BLOCKS.split(", ")],
                )
                number += 1

    return docs.mapInArrow(tokenise, BLOCKS)


def counted(blocks: DataFrame) -> DataFrame:
    """``block, pos, level, uses, c, first``: the unit's place in its block, uses in the block and in all; first: the block is the first that has it."""
    # place and uses share a number: rows are many and should be short
    each = blocks.select("block", F.posexplode(F.arrays_zip("hash", "uses")).alias("pos", "u"))
    dealt = each.select("block", "u.hash", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("u.uses").cast("long")).alias("place")).repartition("hash")
    uses = F.col("place").bitwiseAND(0xFFFFFFFF)
    # merged at every size, as both sides grow with the corpus; both are dealt by the same exchange
    sums = dealt.groupBy("hash").agg(F.sum(uses).alias("c"), F.min(F.struct("block", "place")).alias("lead")).hint("merge")
    level = F.col("hash").bitwiseAND(7).cast("byte")
    first = F.struct("block", "place") == F.col("lead")
    return dealt.join(sums, "hash").select("block", F.shiftright("place", 32).cast("int").alias("pos"), level.alias("level"), uses.cast("int").alias("uses"), "c", first.alias("first"))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double, phrase_score double"


def score_texts(docs: DataFrame, model: str = MODEL, discount: float = DISCOUNT, levels: tuple[int, ...] = LEVELS, shares: tuple[float, ...] = SHARES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score, phrase_score``.

    ``base_score`` is the add-0.1 unigram score of the tokens, ``score`` the log10 marginal
    probability of the whole text over the vocabulary's pieces under their existing scores, ``word_score`` that with
    training words as arcs too, ``phrase_score`` that with training phrases besides. Null and empty texts are one end token. A null doc_id is trained on. Repeated rows
    count as often as they are there. An empty table gives none; other columns are ignored. A
    text's score depends on the set of rows only, not on how they are dealt. Words are told apart by
    63-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces, single, scores = load_pieces(model)
    data = (pieces, single, rank_weights(scores, pieces))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = materialize(blocks_of(base.withColumn("held_out", held_out(F.col("doc_id"))), data, levels, block), "blocks")
    units = materialize(counted(blocks), "units")
    sums = {r.level: r for r in units.groupBy("level").agg(F.sum("uses").alias("uses"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("distinct")).collect()}  # a row for each level
    n_words, v_words = (int(sums[0].uses), int(sums[0].distinct)) if 0 in sums else (0, 0)
    n_phrases = [max(int(sums[q + 1].uses), 1) if q + 1 in sums else 1 for q in range(len(levels))]
    n_tails = int(sums[TAILS].uses) if TAILS in sums else 0
    n_train = int(blocks.agg(F.sum("n_train")).first()[0] or 0)
    n, v = n_words + n_train, v_words + (n_train > 0)

    def score(key, left, right):
        c = np.asarray(left["uses"].combine_chunks().flatten()).astype(np.int64)
        more = np.asarray(right["more"])
        c[more >> 40] = more & (1 << 40) - 1
        row = pa.ipc.open_stream(left["payload"][0].as_buffer()).read_next_batch()
        part = {k: row[k].flatten() for k in row.schema.names}
        doc_id = part.pop("doc_id")
        part = {k: np.asarray(x) if k == "train" else x.to_numpy(zero_copy_only=False) for k, x in part.items()}
        train, size, word = part["train"], part["size"], sum(part[f"word{k}"].astype(np.int64) << 8 * k for k in range(3))
        spelt = np.zeros(len(c))
        spelt[: len(part["spelt"])] = part["spelt"]
        m, doc = len(size), np.repeat(np.arange(len(size)), size)
        end = (n_train + 1.0) / (n + 2.0)
        go, stop = np.log1p(-end), np.log(end)
        with np.errstate(divide="ignore"):
            mass = spelt
            if n_words:
                unseen = spelt + np.log1p(-n_tails / n_words) if n_tails < n_words else np.full(len(c), -np.inf)
                at = part["tailed"]
                unseen[at] = np.logaddexp(unseen[at], np.log(c[part["stem"]] / n_words) + np.log(c[part["tail"]] / n_words))
                mass = np.logaddexp(np.log(np.maximum(c - discount, 0.0) / n_words), np.log(discount * v_words / n_words) + unseen)
        plain = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        ended = np.log10((n_train + 0.1) / (n + 0.1 * (v + 1)))
        text = np.zeros(m)
        if len(word):
            arcs, owner = [], doc
            for q, most in enumerate(n_phrases):
                parts, passage = part[f"parts{q}"], part[f"phrase{q}"]
                begin, many = np.cumsum(parts) - parts, np.flatnonzero(parts > 1)
                owner = owner[begin]
                own = owner[many]
                _, where, often = np.unique(own * np.int64(len(c)) + passage, return_inverse=True, return_counts=True)
                others = c[passage] - np.where(train[own], often[where], 0) if len(own) else np.zeros(0)
                hit = others > 0
                arcs.append((begin, many, many[hit], np.log((others[hit] - PHRASE_DISCOUNT) / most) + go))
            ways = []
            for share in shares:
                way = mass[word] + go
                for begin, many, hit, quoted in arcs:
                    way = np.add.reduceat(way, begin)
                    way[many] += np.log1p(-share)
                    way[hit] = np.logaddexp(way[hit], np.log(share) + quoted)
                ways.append(np.bincount(owner, way, m))
            top = np.max(ways, axis=0)
            text = top + np.log(np.exp(ways - top).mean(axis=0))
        seen = np.bincount(doc, c[word] > 0, m).astype(np.int64) + (n_train > 0)
        return pa.table({
            "doc_id": doc_id, "held_out": pa.array(~train), "n_tokens": pa.array(size.astype(np.int64) + 1), "n_known": pa.array(seen), "train_tokens": pa.array(np.full(m, n)),
            "base_score": pa.array(np.bincount(doc, plain[word], m) + ended), "score": pa.array((np.bincount(doc, spelt[word] + go, m) + stop) / np.log(10.0)),
            "word_score": pa.array((np.bincount(doc, mass[word] + go, m) + stop) / np.log(10.0)), "phrase_score": pa.array((text + stop) / np.log(10.0)),
        })

    # what only one block has needs no answer: its own uses are all
    back = units.where("c > uses").select("block", F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(F.col("c")).alias("more"))
    left = blocks.select("block", "uses", "payload")
    out = materialize(left.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, SCORES), "scores")
    discard(units)
    discard(blocks)
    return out


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of those that aren't held out.

    ``score`` is the sum over the lattice with all its arcs: pieces, training words and training phrases. ``word_score`` is
    that without phrases, ``piece_score`` that of the pieces alone, which learn nothing from the documents.
    """
    s = score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return s.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("phrase_score").alias("score"), "word_score", F.col("score").alias("piece_score"))
