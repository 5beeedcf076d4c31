"""Piece vocabularies and their segmentation lattices, shared by the tokenizer and the language identifier.

A vocabulary's pieces lie in a double-array trie over UTF-8 bytes, with the white-space marker stored as a
space. ``lattice`` walks the trie from every position of many words at once and returns the words' edges;
Viterbi, forward and backward passes then run over the same edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

import numpy as np

MARKER = "▁"
VECTOR_BYTES = 40  # longer words take the scalar walk
FALLBACK_PENALTY = 10.0
SCALE = 3e7  # per byte in sums over segmentations: with probabilities of 1e-12 to 1 none of up to VECTOR_BYTES bytes leaves a double's range
_UP = SCALE ** np.arange(VECTOR_BYTES + 1)


@dataclass
class Vocabulary:
    """Pieces as bytes (marker as space), log scores, and their trie. Id ``size`` stands for any other character."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece, -1 if none
    usable: np.ndarray  # may stand in a segmentation
    base: np.ndarray = field(default=None)
    check: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.base is None:
            self.base, self.check, self.value = double_array({p: i for i, p in enumerate(self.pieces) if self.usable[i]})
        self.longest = max((len(p) for i, p in enumerate(self.pieces) if self.usable[i]), default=1)
        self.has_newline = any(b"\n" in p for i, p in enumerate(self.pieces) if self.usable[i])

    @property
    def size(self) -> int:
        return len(self.pieces)

    @property
    def fallback_score(self) -> float:
        return float(self.scores[self.usable].min()) - FALLBACK_PENALTY if self.usable.any() else -FALLBACK_PENALTY


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie of byte strings; node 0 is the root, value -1 ends no word."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, number in words.items():
        at = 0
        for byte in word:
            if byte not in children[at]:
                children[at][byte] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][byte]
        ends[at] = number
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    value[0] = ends[0]
    place, low, sparse = {0: 0}, 1, 1
    window = np.arange(2048)
    queue = [0]
    for node in queue:
        kids = sorted(children[node])
        if not kids:
            continue
        while used[low]:
            low += 1
        start = max(1, (low if len(kids) == 1 else max(low, sparse)) - kids[0])
        while True:
            while start + 4096 > len(used):
                grow = len(used)
                base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                used = np.concatenate([used, np.zeros(grow, bool)])
            taken = used[start + kids[0] + window]
            for byte in kids[1:]:
                taken |= used[start + byte + window]
            if not taken.all():
                start += int(np.argmin(taken))
                break
            start += len(window)
        if len(kids) > 1:
            sparse = max(sparse, start + kids[0] - 1024)
        base[place[node]] = start
        for byte in kids:
            child, slot = children[node][byte], start + byte
            used[slot], check[slot], value[slot], place[child] = True, place[node], ends[child], slot
            queue.append(child)
    return base, check, value


def load_vocabulary(path: str) -> Vocabulary:
    """A public SentencePiece model's pieces, with log scores by Zipf's rule over their order of merit.

    Models whose scores are merge ranks hold no probabilities; rank r of V pieces gets 1 / (r * H(V)).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw = np.array([model.get_score(i) for i in range(n)])
    special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(n)])
    is_byte = np.array([model.is_byte(i) for i in range(n)])
    usable = ~(special | is_byte)
    ranks = np.zeros(n)
    ranks[np.flatnonzero(usable)[np.argsort(-raw[usable], kind="stable")]] = np.arange(1, usable.sum() + 1)
    total = float((1 / ranks[usable]).sum()) if usable.any() else 1.0
    scores = np.where(usable, -np.log(np.maximum(ranks, 1)) - log(total), 0.0)
    texts = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    for i in np.flatnonzero(is_byte):
        byte_ids[int(texts[i][3:5], 16)] = i
    pieces = [bytes([int(t[3:5], 16)]) if is_byte[i] else b"" if special[i] else t.replace(MARKER, " ").encode() for i, t in enumerate(texts)]
    return Vocabulary(pieces, scores, byte_ids, usable)


#: Length of the UTF-8 character that starts with each byte; a stray continuation byte counts as one.
CHAR_BYTES = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


@dataclass
class Step:
    """Edges that start at the same byte: word rows, ends and piece ids; each (row, end) once."""

    start: int
    rows: np.ndarray
    ends: np.ndarray
    ids: np.ndarray


def lattice(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, list[Step]]:
    """Lengths and edges of the words, by start. A character no piece covers alone gets an edge of id ``size``.

    A piece's walk from a byte that no edge reaches is skipped, as no segmentation passes there.
    """
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    width = int(lens.max(initial=0))
    letters = np.zeros((n, width + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    letters[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    reached = np.zeros((n, width + 5), bool)
    reached[:, 0] = True
    steps: list[Step] = []
    base, check, value = vocab.base, vocab.check, vocab.value
    for s in range(width):
        rows = np.flatnonzero(reached[:, s] & (s < lens))
        if not len(rows):
            continue
        char = np.minimum(CHAR_BYTES[letters[rows, s]], lens[rows] - s)
        alone = np.zeros(len(rows), bool)
        live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(min(vocab.longest, width - s)):
            keep = s + d < lens[rows[live]]
            live, node = live[keep], node[keep]
            to = base[node] + letters[rows[live], s + d]
            keep = check[to] == node
            live, node = live[keep], to[keep].astype(np.int64)
            if not len(live):
                break
            ids = value[node]
            end = ids >= 0
            if end.any():
                at = live[end]
                alone[at[char[at] == d + 1]] = True
                parts.append((rows[at], np.full(len(at), s + d + 1), ids[end].astype(np.int64)))
        other = np.flatnonzero(~alone)
        if len(other):
            parts.append((rows[other], s + char[other], np.full(len(other), vocab.size)))
        r, e, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        reached[r, e] = True
        steps.append(Step(s, r, e, i))
    return lens, steps


def forward(lens: np.ndarray, steps: list[Step], probs: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of the product of ``probs[id, k]``, times ``SCALE`` to the power of ``end``: alpha[row, end, k]."""
    alpha = np.zeros((len(lens), int(lens.max(initial=0)) + 1, probs.shape[1]))
    alpha[:, 0] = 1
    for x in steps:  # each (row, end) occurs once in a step, so += by index is safe
        alpha[x.rows, x.ends] += alpha[x.rows, x.start] * (probs[x.ids] * _UP[x.ends - x.start, None])
    return alpha


def backward(lens: np.ndarray, steps: list[Step], probs: np.ndarray) -> np.ndarray:
    """The same from each start to the word's end, for one column of probabilities: beta[row, start], scaled by the bytes passed."""
    beta = np.zeros((len(lens), int(lens.max(initial=0)) + 1))
    beta[np.arange(len(lens)), lens] = 1
    for x in reversed(steps):
        beta[:, x.start] += np.bincount(x.rows, probs[x.ids] * _UP[x.ends - x.start] * beta[x.rows, x.ends], len(lens))
    return beta


def viterbi(lens: np.ndarray, steps: list[Step], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score of each prefix, and its last edge's start and id; the earliest start wins ties."""
    shape = (len(lens), int(lens.max(initial=0)) + 1)
    best, start, ids = np.full(shape, -np.inf), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    best[:, 0] = 0
    for x in steps:
        found = best[x.rows, x.start] + scores[x.ids]
        better = found > best[x.rows, x.ends]
        r, e = x.rows[better], x.ends[better]
        best[r, e], start[r, e], ids[r, e] = found[better], x.start, x.ids[better]
    return best, start, ids


def word_edges(vocab: Vocabulary, word: bytes):
    """The edges (start, end, id) of one word of any length, by start, walked byte by byte."""
    base, check, value = vocab.base, vocab.check, vocab.value
    n = len(word)
    reached = bytearray(n + 5)
    reached[0] = 1
    for s in range(n):
        if not reached[s]:
            continue
        char = min(int(CHAR_BYTES[word[s]]), n - s)
        node, alone = 0, False
        for e in range(s, min(n, s + vocab.longest)):
            to = int(base[node]) + word[e]
            if check[to] != node:
                break
            node = to
            if value[node] >= 0:
                alone |= e + 1 - s == char
                reached[e + 1] = 1
                yield s, e + 1, int(value[node])
        if not alone:
            reached[s + char] = 1
            yield s, s + char, vocab.size


def word_viterbi(vocab: Vocabulary, word: bytes, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation of one word of any length, as edges in order."""
    best, last = [float("-inf")] * (len(word) + 1), [None] * (len(word) + 1)
    best[0] = 0.0
    for s, e, i in word_edges(vocab, word):
        if (found := best[s] + scores[i]) > best[e]:
            best[e], last[e] = found, (s, e, i)
    out, at = [], len(word)
    while at:
        out.append(last[at])
        at = last[at][0]
    return out[::-1]


def word_log_forward(vocab: Vocabulary, word: bytes, log_probs: np.ndarray) -> np.ndarray:
    """Log of the sum over segmentations of one word of any length, for each column of ``log_probs``."""
    alpha: dict[int, np.ndarray] = {0: np.zeros(log_probs.shape[1])}
    for s, e, i in word_edges(vocab, word):  # edges come by start, so alpha[s] is complete when it is read
        found = alpha[s] + log_probs[i]
        alpha[e] = np.logaddexp(alpha[e], found) if e in alpha else found
    return alpha[len(word)]
