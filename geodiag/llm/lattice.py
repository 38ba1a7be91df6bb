"""Piece lattices of many strings at once.

A vocabulary's pieces are byte strings (the word mark is a space). The lattice of a string has a
node between any two bytes and an arc for each piece found; a character that is no piece of
its own also has arcs for its bytes. Arcs of all strings of a batch are found by hashing all
substrings up to the longest piece's length, and recursions run over all strings in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geodiag.llm.words import U64, _power_tables, _TAB, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = MODEL) -> tuple[list[bytes], list[int], np.ndarray]:
    """Byte strings of a SentencePiece model's pieces (b"" for control pieces), the ids of the 256 byte pieces, the scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, single = [b""] * n, [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            single[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
    if min(single) < 0:
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    return pieces, single, np.array([sp.get_score(i) for i in range(n)])


def rank_weights(scores: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Log probabilities from the vocabulary's scores.

    Scores that are log probabilities are only normalised. A merge-based vocabulary's scores
    are minus a merge's rank; by Zipf's law a piece of rank r weighs 1 / (r + 3). Byte pieces
    weigh as the last rank.
    """
    real = np.array([bool(p) for p in pieces])
    if scores[real].min() > -100:
        w = np.where(real, scores, scores[real].min() - 10)
    else:
        order = np.argsort(-np.where(real, scores, -np.inf), kind="stable")
        rank = np.empty(len(scores))
        rank[order] = np.arange(len(scores))
        w = -np.log(np.where(real, rank, len(scores)) + 3.0)
    return w - np.log(np.exp(w).sum())


class Vocabulary:
    """Pieces with a hash index; weights are passed to each recursion."""

    def __init__(self, pieces: list[bytes], single: list[int]):
        self.pieces = [p or (bytes([single.index(i)]) if i in set(single) else b"") for i, p in enumerate(pieces)]
        self.single = np.array(single)
        text = [(p, i) for i, p in enumerate(pieces) if p]
        self.longest = max(len(p) for p, _ in text)
        flat = np.frombuffer(b"".join(p for p, _ in text), np.uint8)
        size = np.array([len(p) for p, _ in text])
        end = np.cumsum(size)
        h = substring_hash(*prefix_sums(flat), end - size, size)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([i for _, i in text])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> U64(44)).astype(np.int64)] = True
        #: byte pairs that stand inside a piece; between others no piece can reach
        inside = np.zeros(1 << 16, bool)
        for p, _ in text:
            a = np.frombuffer(p, np.uint8).astype(np.int64)
            inside[a[:-1] * 256 + a[1:]] = True
        self.inside = inside
        raw = [p for p in self.pieces]
        self.length = np.array([len(p) for p in raw])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of pieces."""
        n = self.length[ids]
        stop = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pw, inv = _power_tables(len(buf) + 1)
    p = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TAB[buf] * pw[: len(buf)], out=p[1:])
    return p, inv


def substring_hash(p: np.ndarray, inv: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return mix((p[start + size] - p[start]) * inv[start] + np.asarray(size).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Lattice:
    """Arcs of a batch of strings, by end node. Node ``root[i] + j`` is before byte j of string i."""

    root: np.ndarray
    size: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    piece: np.ndarray
    begin: np.ndarray  # of each node's arcs, and their end
    rounds: list[np.ndarray]  # nodes with arcs, by distance from the root


def build(v: Vocabulary, buf: np.ndarray, off: np.ndarray) -> Lattice:
    """Lattice of the strings ``buf[off[i]:off[i+1]]``."""
    n, size = len(off) - 1, np.diff(off)
    p, inv = prefix_sums(buf)
    string = np.repeat(np.arange(n), size)
    left = off[1:][string] - np.arange(len(buf))  # bytes to the string's end
    src, dst, ids = [], [], []
    lead = (buf & 0xC0) != 0x80
    width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
    own = np.zeros(len(buf), bool)
    at = np.flatnonzero(lead)
    for k in range(1, v.longest + 1):
        at = at[left[at] >= k]
        if not len(at):
            break
        found = v.find(substring_hash(p, inv, at, k))
        hit = found >= 0
        a = at[hit]
        src.append(a)
        dst.append(a + k)
        ids.append(found[hit])
        own[a[width[a] == k]] = True
    # bytes of characters that are no piece
    first = np.maximum.accumulate(np.where(lead, np.arange(len(buf)), 0)) if len(buf) else np.zeros(0, np.int64)
    alone = np.flatnonzero(~(own[first] & (string[first] == string)))
    src.append(alone)
    dst.append(alone + 1)
    ids.append(v.single[buf[alone]])
    # longer pieces first: they are likelier, and sampling tries a node's arcs in order
    src, dst, ids = (np.concatenate(x[::-1]) for x in (src, dst, ids))
    # to nodes: one more for each string
    dst = dst + string[src]
    src = src + string[src]
    order = np.argsort(dst, kind="stable")
    src, dst, ids = src[order], dst[order], ids[order]
    nodes = len(buf) + n
    begin = np.searchsorted(dst, np.arange(nodes + 1))
    root = off[:-1] + np.arange(n)
    depth = np.arange(nodes) - np.repeat(root, size + 1)
    with_arcs = np.flatnonzero(begin[1:] > begin[:-1])
    by = with_arcs[np.argsort(depth[with_arcs], kind="stable")]
    cuts = np.searchsorted(depth[by], np.arange(1, (int(depth.max()) if nodes else 0) + 2))
    return Lattice(root, size, src, dst, ids, begin, [by[a:b] for a, b in zip(cuts, cuts[1:]) if b > a])


def _arcs(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All arcs that end in ``nodes``, and where each node's begin among them."""
    n = begin[nodes + 1] - begin[nodes]
    stop = np.cumsum(n)
    return np.repeat(begin[nodes] - (stop - n), n) + np.arange(stop[-1]), stop - n


def forward(g: Lattice, w: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all paths from a string's root to each node."""
    alpha = np.full(len(g.begin) - 1, -np.inf)
    alpha[g.root] = 0.0
    weight = w[g.piece]
    for nodes in g.rounds:
        k, first = _arcs(g.begin, nodes)
        x = alpha[g.src[k]] + weight[k]
        top = np.maximum.reduceat(x, first)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            alpha[nodes] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(first, len(k))))), first))
    return alpha


def posteriors(g: Lattice, w: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Probability that a path drawn by weight takes each arc."""
    with np.errstate(invalid="ignore"):
        take = np.exp(alpha[g.src] + w[g.piece] - alpha[g.dst])  # of the arc, given its end node
    take[~np.isfinite(take)] = 0.0
    reach = np.zeros(len(alpha))
    reach[g.root + g.size] = 1.0
    out = np.zeros(len(take))
    for nodes in reversed(g.rounds):
        k, first = _arcs(g.begin, nodes)
        out[k] = take[k] * np.repeat(reach[nodes], np.diff(np.append(first, len(k))))
        np.add.at(reach, g.src[k], out[k])
    return out


def sample(g: Lattice, w: np.ndarray, alpha: np.ndarray, string: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling: a path for each occurrence of a string, drawn from ``key`` (64 bits for an occurrence).

    Pieces of all occurrences in order, and how many each has.
    """
    with np.errstate(invalid="ignore"):
        p = np.exp(alpha[g.src] + w[g.piece] - alpha[g.dst])
    p[~np.isfinite(p)] = 0.0
    src, piece = g.src, g.piece
    total = np.concatenate([[0.0], np.cumsum(p)])
    cdf = total[1:] - np.repeat(total[g.begin[:-1]], np.diff(g.begin))
    last = g.begin[1:] - 1
    node, root = (g.root + g.size)[string], g.root[string]
    live = np.flatnonzero(node > root)
    node = node[live]
    count, taken, step = np.zeros(len(string), np.int64), [], 0
    while len(live):
        u = (mix(key[live] + U64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) * 2.0**-53
        arc, end = g.begin[node], last[node]
        more = np.flatnonzero((u >= cdf[arc]) & (arc < end))
        while len(more):
            arc[more] += 1
            more = more[(u[more] >= cdf[arc[more]]) & (arc[more] < end[more])]
        taken.append((live, piece[arc]))
        count[live] += 1
        node = src[arc]
        go = node > root[live]
        live, node, step = live[go], node[go], step + 1
    stop = np.cumsum(count)
    out = np.empty(stop[-1] if len(stop) else 0, np.int32)
    for s, (who, what) in enumerate(taken):
        out[stop[who] - 1 - s] = what
    return out, count
