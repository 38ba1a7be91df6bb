"""Operator 9: sampled SentencePiece encoding and lossless decoding.

Forward filtering sums the weights of all segmentations of each distinct stretch of a block of
text; backward sampling then draws pieces from the end of every occurrence. A draw depends on
the seed, the row's key and the place in its text only, so any partitioning gives the same
segmentation. Texts are cut into stretches between bytes that no piece spans, which leaves the
distribution of segmentations as it is. Spaces are pieces' own bytes and unknown characters are
byte pieces, so decoding gives back every byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodiag.llm.lattice import MODEL, Vocabulary, build, forward, load_pieces, rank_weights, sample
from geodiag.llm.tables import table
from geodiag.llm.words import U64, chunks, hash_spans, mix, text_buffer
from geodiag.runtime import ship

BLOCK = 4 << 20
_cache: dict = {}


def _vocabulary(data) -> tuple[Vocabulary, np.ndarray]:
    """One per Python worker."""
    pieces, single, weights = data
    known = (len(pieces), hash(tuple(pieces)), weights.tobytes()[:64], float(weights.sum()))
    if known not in _cache:
        _cache.clear()
        _cache[known] = (Vocabulary(pieces, single), weights)
    return _cache[known]


def stretches(v: Vocabulary, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of a buffer, and how many each document has."""
    cut = np.ones(len(buf), bool)
    cut[1:] = ~v.inside[buf[:-1].astype(np.int64) * 256 + buf[1:]]
    cut[1:] |= (buf[1:] == 32) & (buf[:-1] != 32)  # no piece has a space after another byte
    begin = off[:-1]
    cut[begin[begin < len(buf)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, off))


def encode_block(v: Vocabulary, w: np.ndarray, buf: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all documents of a buffer, and how many each has."""
    starts, n = stretches(v, buf, off)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    stops = np.append(starts[1:], len(buf))
    _, first, string = np.unique(hash_spans(buf, starts, stops, fold=False), return_index=True, return_inverse=True)
    size = stops[first] - starts[first]
    end = np.cumsum(size)
    distinct = buf[np.repeat(starts[first] - (end - size), size) + np.arange(end[-1])]
    g = build(v, distinct, np.concatenate([[0], end]))
    alpha = forward(g, w)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
    key = mix(np.repeat(keys, n) + place.astype(U64) * U64(0xBF58476D1CE4E5B9))
    ids, count = sample(g, w, alpha, string, key)
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.concatenate([[0], np.cumsum(n)])
    return ids, np.diff(total[at])


def encode(docs: DataFrame, model: str = MODEL, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """``docs`` (doc_id, text and any others) plus ``ids``, a sampled segmentation of each whole text.

    ``alpha`` is the usual inverse temperature: weights are raised to it. Null and empty texts
    have no ids; equal rows get equal ids; a null doc_id is a key like any other. A column
    ``ids`` in the input is replaced. The vocabulary is read on the driver and sent along: its
    size is fixed.
    """
    ship(docs.sparkSession)
    pieces, single, scores = load_pieces(model)
    data = (pieces, single, alpha * rank_weights(scores, pieces))
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        v, w = _vocabulary(data)
        for batch in batches:
            col = batch["text"]
            buf, off = text_buffer(col)
            row = np.asarray(pc.fill_null(pc.cast(batch["doc_id"], pa.int64()), -1)).astype(np.int64).view(U64)
            keys = mix(row ^ mix(np.full(len(row), seed, U64)))
            for i, j in chunks(off, BLOCK):
                ids, n = encode_block(v, w, buf[off[i] : off[j]], off[i : j + 1] - off[i], keys[i:j])
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=[*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, column: str = "decoded") -> DataFrame:
    """``encoded`` plus ``column``: the text that ``ids`` stand for; null ids give an empty text."""
    ship(encoded.sparkSession)
    pieces, single, scores = load_pieces(model)
    data = (pieces, single, rank_weights(scores, pieces))
    encoded = encoded.drop(column)
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])

    def run(batches):
        v, _ = _vocabulary(data)
        for batch in batches:
            step = 2000
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                lists = part["ids"]
                ids = np.asarray(lists.flatten()).astype(np.int64)
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                raw = v.decode(ids)
                size = np.concatenate([[0], np.cumsum(v.length[ids])])[np.concatenate([[0], np.cumsum(n)])]
                text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(size.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, column])

    return encoded.mapInArrow(run, schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: how many pieces, their hash, and whether every text came back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = decode(encode(docs))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))
