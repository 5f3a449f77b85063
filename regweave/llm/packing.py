"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are spread over groups at random (about GROUP documents or GROUP_BYTES of text each, whichever makes
smaller groups); every group is tokenized and packed by itself, so the work of a task is bounded by its group. A document longer than a sequence is cut into full sequences
and a rest. Rests are placed longest first: the tournament tree holds the free room of every open bin, with the
larger of two children in each inner node, and walking down from the root finds the first bin that fits in
logarithmic time. Afterwards the emptiest bins are cut up to fill the gaps of the others, so that at most one bin of
a group is short; that one is cut at powers of two, which need no padding.

Tokenization is shared between equal words: a text is split at ASCII white space, which the tokenizer drops anyway
and never joins across, and each word's ids are kept in a bounded table of the worker.

Defined cases: a null or empty text has only the end id; repeated rows (also of one doc_id) are packed one by one; a
null doc_id is carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
GROUP = 1024
#: Groups get smaller where documents are long: about this many bytes of text at most (or one longer document).
GROUP_BYTES = 8 << 20
SEED = 20240611
MAX_WORDS = 1_000_000
MARKS = string.punctuation.encode()
_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _letter_run(word: bytes) -> str | None:
    """The word as the tokenizer's model sees it, where normalizing and splitting leave one run of letters.

    True for ASCII letters, and for words of composed Latin letters, whose lower case is letter by letter.
    """
    if word.isalpha():
        return word.decode()
    text = word.decode("utf-8", "replace")
    if not text.isalpha() or not all(c < "\u0080" or "\u00c0" <= c < "\u0130" for c in text):
        return None
    return text.lower().encode().decode("latin-1").translate(_BYTES)


class WordTokenizer:
    """Ids of whole texts, word by word, through a bounded table of known words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.model = self.inner.model
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        """Put the ids of new words in the table."""
        cut, fresh = {}, set()
        for w in words:  # marks that close a word follow its last letter or digit as one token run of their own
            core = w.rstrip(MARKS)
            if core and core != w and core[-1:].isalnum():
                cut[w] = core
                fresh.add(core)
                fresh.add(w[len(core) :])
            else:
                fresh.add(w)
        known, mixed = self.known, []
        for w in fresh:
            if w in known:
                continue
            run = _letter_run(w)
            if run is None:
                mixed.append(w)
            else:
                ids = [t.id for t in self.model.tokenize(run)]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        got = self.inner.encode_batch_fast([w.decode("utf-8", "replace") for w in mixed], add_special_tokens=False)
        known.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in zip(mixed, [e.ids for e in got]))
        for w, core in cut.items():
            known[w] = known[core] + known[w[len(core) :]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > MAX_WORDS:
            self.known = {}
        out = []
        for t in texts:
            words = t.lower().split()
            ids = list(map(self.known.get, words))
            if None in ids:
                self._learn({w for w, x in zip(words, ids) if x is None})
                ids = [self.known[w] for w in words]
            out.append(b"".join(ids))
        return out


def first_fit_decreasing(sizes: np.ndarray, room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers; items (each at most ``room``) are placed longest first, ties in their order."""
    n = len(sizes)
    width = 1
    while width < max(n, 1):
        width *= 2
    tree = [0] * width + [room] * n + [0] * (width - n)
    for i in range(width - 1, 0, -1):
        tree[i] = max(tree[2 * i], tree[2 * i + 1])
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        if node - width == len(bins):
            bins.append([])
        bins[node - width].append(item)
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def pack(lengths: np.ndarray, room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); every position of every document is in exactly one of them."""
    out: list[list[tuple[int, int, int]]] = []
    docs, starts, sizes = [], [], []
    for d, n in enumerate(lengths.tolist()):
        full = n // room * room
        out += [[(d, s, room)] for s in range(0, full, room)]
        if n > full:
            docs.append(d)
            starts.append(full)
            sizes.append(n - full)
    bins = [[(docs[i], starts[i], sizes[i]) for i in b] for b in first_fit_decreasing(np.array(sizes, np.int64), room)]
    gaps = [(room - sum(p[2] for p in b), k) for k, b in enumerate(bins)]
    out += [bins[k] for g, k in gaps if g == 0]
    heap = [(g, k) for g, k in gaps if g]
    heap.sort()  # fullest first
    lo, hi = 0, len(heap) - 1
    while lo < hi:  # cut up the emptiest bin to fill the fullest ones
        giver = bins[heap[hi][1]]
        gap, k = heap[lo]
        while gap and giver:
            d, s, n = giver.pop()
            take = min(n, gap)
            bins[k].append((d, s + n - take, take))
            gap -= take
            if n > take:
                giver.append((d, s, n - take))
        if gap:
            heap[lo] = (gap, k)
        else:
            out.append(bins[k])
            lo += 1
        if not giver:
            hi -= 1
    if lo == hi and bins[heap[lo][1]]:
        rest = bins[heap[lo][1]]
        left = sum(p[2] for p in rest)
        rest.reverse()
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            seq = []
            while want:
                d, s, n = rest.pop()
                take = min(n, want)
                seq.append((d, s, take))
                want -= take
                if n > take:
                    rest.append((d, s + take, n - take))
            out.append(seq)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece."""
    path = tokenizer or default_tokenizer()
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size["n"] // group), -(-size["b"] // GROUP_BYTES))

    def run(table: pa.Table) -> pa.Table:
        if path not in _state:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _state[path] = WordTokenizer(path)
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        end = np.array([END_ID], dtype="<u4").tobytes()
        ids = [x + end for x in _state[path].encode(texts)]
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        number = table.column("grp")[0].as_py() << 32
        rows: list[tuple] = []
        for k, seq in enumerate(pack(lengths, room)):
            at = 0
            for d, s, n in seq:
                rows.append((d, s, n, zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]), number + k, at))
                at += n
        d, s, n, crc, seq_id, at = (np.array(c, np.int64) for c in zip(*rows))
        return pa.table(
            {"doc_id": table.column("doc_id").take(pa.array(d)), "start": s, "length": n, "ids_crc32": crc,
             "doc_tokens": lengths[d], "sequence_id": seq_id, "offset": at}
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"), F.floor(F.rand(SEED) * groups).cast("long").alias("grp"),
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.groupBy("grp").applyInArrow(run, schema)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
