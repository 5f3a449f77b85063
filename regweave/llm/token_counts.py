"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with its word mark, as the vocabulary's pieces see it. The distinct pre-tokens of a block of
texts form a trie. The best unigram score of reaching a trie node depends only on the characters above it, so
the forward step is computed once per node, for all nodes of a depth together: best(node) = max over pieces ending
there of best(start of the piece) + score(piece). A pre-token's terminal node gives its number of tokens, and
a text's count is the sum over its words. Nothing is shuffled; memory is bounded by the block.

Scores are the vocabulary file's own. Ties go to fewer tokens, then to the longer last piece. A character
without a piece costs one fallback token per byte.

Defined cases: null and empty texts have no pre-tokens and no tokens; repeated rows are counted one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import text as T

BLOCK_BYTES = 4 << 20
FALLBACK = -1e6
MARK = "▁".encode()
_loaded: dict[str, Pieces] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """Piece hashes (sorted) with scores, and the lengths in bytes that occur."""

    keys: np.ndarray
    scores: np.ndarray
    lengths: list[int]

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.scores[at], -np.inf)


def piece_table(pieces: list[tuple[str, float]]) -> Pieces:
    """Table of pieces as UTF-8 bytes; of pieces given twice the better score counts."""
    best: dict[bytes, float] = {}
    for p, s in pieces:
        b = p.encode()
        best[b] = max(s, best.get(b, -np.inf))
    names = list(best)
    data = np.frombuffer(b"".join(names), np.uint8)
    size = np.array([len(n) for n in names])
    end = np.cumsum(size)
    keys = T.Texts(data, end - size, end).hash_spans(end - size, end)
    order = np.argsort(keys)
    return Pieces(keys[order], np.array([best[n] for n in names])[order], sorted({len(n) for n in names}))


def load_pieces(path: str) -> Pieces:
    """Normal pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        _loaded[path] = piece_table([(sp.id_to_piece(i), sp.get_score(i)) for i in ids])
    return _loaded[path]


def count_tokens(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and best score of each pre-token (distinct byte strings), over their shared trie."""
    order = sorted(range(len(words)), key=words.__getitem__)
    size = np.array([len(words[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    end = np.cumsum(size)
    start = end - size
    flat = T.Texts(data, start, end)
    n, deepest = len(words), int(size.max(initial=0))
    node = np.zeros(n, np.int64)  # trie node of every word's prefix at the current depth
    score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]  # per depth, per node; the root is depth 0
    node_of = [node]  # per depth, node of every word that is long enough
    word_of = [np.arange(n)]
    total, count = np.zeros(n), np.zeros(n, np.int64)
    alive = np.arange(n)
    for depth in range(1, deepest + 1):
        alive = alive[size[alive] >= depth]
        # words are sorted: a prefix is new where it differs from the one before it
        prefix = flat.hash_spans(start[alive], start[alive] + depth)
        fresh = np.ones(len(alive), bool)
        fresh[1:] = prefix[1:] != prefix[:-1]
        here = np.cumsum(fresh) - 1
        node_of.append(here)
        word_of.append(alive)
        first = alive[fresh]  # one word stands for each node
        best, fewest = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        for width in sorted(pieces.lengths, reverse=True):
            if width > depth:
                continue
            s = start[first] + depth - width
            gain = pieces.find(flat.hash_spans(s, s + width))
            back = depth - width
            at = node_of[back][np.searchsorted(word_of[back], first)]
            reach, steps = score[back][at] + gain, tokens[back][at] + 1
            better = (reach > best) | ((reach == best) & (reach > -np.inf) & (steps < fewest))
            best, fewest = np.where(better, reach, best), np.where(better, steps, fewest)
        at = node_of[depth - 1][np.searchsorted(word_of[depth - 1], first)]
        reach = score[depth - 1][at] + FALLBACK  # a byte that no piece covers
        better = reach > best
        best, fewest = np.where(better, reach, best), np.where(better, tokens[depth - 1][at] + 1, fewest)
        score.append(best)
        tokens.append(fewest)
        ends = size[alive] == depth
        total[alive[ends]], count[alive[ends]] = best[here[ends]], fewest[here[ends]]
        if depth > pieces.lengths[-1]:  # no piece reaches further back
            old = depth - pieces.lengths[-1] - 1
            score[old] = tokens[old] = node_of[old] = word_of[old] = None
    out_count, out_total = np.zeros(n, np.int64), np.zeros(n)
    out_count[order], out_total[order] = count, total
    return out_count, out_total


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, score``: words, tokens and best unigram score of every row's whole text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), limit=BLOCK_BYTES):
                s, e, _, n = t.words()
                _, first, at = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
                raw = t.raw.tobytes()
                count, score = count_tokens([MARK + raw[s[i] : e[i]] for i in first], pieces)
                owner = np.repeat(np.arange(t.n), n)
                tokens = np.bincount(owner, count[at], minlength=t.n).astype(np.int64) if len(at) else np.zeros(t.n, np.int64)
                total = np.bincount(owner, score[at], minlength=t.n) if len(at) else np.zeros(t.n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(tokens), pa.array(total)],
                    ["doc_id", "n_words", "n_tokens", "score"],
                )

    schema = "doc_id long, n_words long, n_tokens long, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
