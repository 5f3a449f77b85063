"""Phrase collocation mining: word sequences counted in burst tries of hash containers, merged per prefix partition.

One scan per phrase length counts the phrases of that length whose two shorter halves (all but the last, all but the
first word) are frequent; a phrase is never more frequent than a part of it, so nothing is lost. Frequent parts reach
the tasks as a Bloom filter of fixed size (``FILTER_BITS``): a false positive only costs a count that is dropped later.

In a task (``PhraseTrie``) words get numbers as they come; a shallow trie over word numbers has hash containers as
leaves, which hold the packed rest of a phrase. A container that outgrows BURST bursts into a node one word deeper.
When a task holds more than SPILL entries, its largest subtrees leave as sorted runs (language, phrase, count).
Spark partitions the runs by prefix (the first two words) and merges each prefix partition.

Parts of the surviving phrases, and phrases inside longer ones, are joined in Spark, on tables of frequent phrases only.
Arithmetic is exact: products are decimals of 38 digits.

Defined cases: a null text is empty; a null lang counts as ``und``; repeated rows count as often as they occur; doc_id
and other columns are not read; empty tables, and languages without a phrase of MIN_COUNT, give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regweave.llm.text import mix
from regweave.session import write_once

MIN_COUNT = 30
MAX_WORDS = 4
COVER_PERCENT = 80
TOP = 2000
SCORE_SCALE = 2_000_000
FILTER_BITS = 26  # 2**26 bits = 8 MB
BURST = 1 << 15
SPILL = 1 << 19
RUN_ROWS = 1 << 16
MAX_IDS = 1 << 19  # word numbers of a task; beyond that the trie is emptied and numbering starts again
ID_BITS = 21
SLICE_BYTES = 4 << 20
RANK_SHARES = 32
NO_LANG = "und"

_BREAK = b"\xff"  # in no UTF-8 text
_PLAIN = bytes(
    0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
RUN_SCHEMA = "lang string, phrase string, f long"


class WordNumbers(dict):
    """Numbers from 1 for words as they are first seen; the piece break is 0."""

    def __init__(self):
        self.words = pa.array([b""], pa.large_binary())
        self.hashes = np.zeros(1, np.uint64)

    def numbers(self, data: bytes) -> np.ndarray:
        """Numbers of the words of plain text, zeros between pieces.

        Equal words are found by Arrow's dictionary encoding, so Python sees each distinct word of the text once.
        """
        raw = np.frombuffer(data, np.uint8)
        cut = raw == _BREAK[0]
        inside = ~cut & (raw != 0x20)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        size = np.flatnonzero(last) - np.flatnonzero(first) + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        found = coded.dictionary.to_pylist()
        own = np.fromiter(map(self.get, found, [0] * len(found)), np.int64, len(found))
        fresh = np.flatnonzero(own == 0)
        own[fresh] = np.arange(len(fresh)) + len(self.words)
        new = [found[i] for i in fresh.tolist()]
        self.update(zip(new, own[fresh].tolist()))
        self.words = pa.concat_arrays([self.words, coded.dictionary.take(pa.array(fresh))])
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        first |= cut
        got = np.zeros(int(np.count_nonzero(first)), np.int64)
        got[inside[first]] = own.take(coded.indices.to_numpy())
        return got


def phrase_hash(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """A hash of word hashes in order, and of the language."""
    h = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


_SHIFTS = (0, 19, 38)


def _bit(h: np.ndarray, shift: int) -> np.ndarray:
    return (h >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)


def frequent_filter(table: DataFrame) -> np.ndarray:
    """The Bloom filter over ``lang, phrase``: bits are set in tasks, at most 2**20 words of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.empty(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
                words = [np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
                h[i] = phrase_hash(lang, words)[0]
            at = np.concatenate([_bit(h, s) for s in _SHIFTS])
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bits"])

    found = table.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _contains(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash is looked up further only as long as its bits are set."""
    left = None
    for shift in _SHIFTS:
        at = _bit(h if left is None else h[left], shift)
        hit = np.flatnonzero(bloom.take((at >> np.uint64(6)).view(np.int64)) >> (at & np.uint64(63)) & np.uint64(1))
        left = hit if left is None else left[hit]
    ok = np.zeros(len(h), bool)
    ok[left] = True
    return ok


class PhraseTrie:
    """Counts of number sequences of one length under a shallow trie; the rest of a sequence is packed in one integer."""

    def __init__(self, length: int):
        self.rest = max(length - 1, 1)  # single words share one container below no word
        self.root: dict[int, dict | Counter] = {}
        self.sizes: Counter[int] = Counter()  # entries below each first word
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        for word, part in _grouped(first, rest):
            before = self.sizes[word]
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = Counter()
            self.root[word], grown = _insert(node, part, self.rest)
            self.sizes[word] = before + grown
            self.entries += grown

    def spill(self, upto: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """Remove whole subtrees, largest first, until at most ``upto`` entries stay: first word, rests, counts."""
        for word, size in self.sizes.most_common():
            if self.entries <= upto:
                break
            keys, counts = _leaves(self.root.pop(word), self.rest)
            del self.sizes[word]
            self.entries -= size
            yield word, keys, counts


def _grouped(first: np.ndarray, rest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(first):
        return
    order = np.argsort(first, kind="stable")
    first, rest = first[order], rest[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    for word, a, b in zip(first[starts].tolist(), starts.tolist(), [*cuts.tolist(), len(first)]):
        yield word, rest[a:b]


def _insert(node: dict, rest: np.ndarray, words: int) -> tuple[dict, int]:
    """Count packed rests of ``words`` words; returns the node (a container may burst) and how many entries are new."""
    if isinstance(node, Counter):
        before = len(node)
        node.update(rest.tolist())
        grown = len(node) - before
        if len(node) > BURST and words > 1:
            shift = ID_BITS * (words - 1)
            burst: dict[int, Counter] = {}
            for key, n in node.items():
                burst.setdefault(key >> shift, Counter())[key & ((1 << shift) - 1)] = n
            return burst, grown
        return node, grown
    shift, grown = ID_BITS * (words - 1), 0
    for word, part in _grouped(rest >> shift, rest & ((1 << shift) - 1)):
        node[word], more = _insert(node.get(word) or Counter(), part, words - 1)
        grown += more
    return node, grown


def _leaves(node: dict, words: int) -> tuple[list[int], list[int]]:
    if isinstance(node, Counter):
        return list(node), list(node.values())
    shift, keys, counts = ID_BITS * (words - 1), [], []
    for word, child in node.items():
        k, c = _leaves(child, words - 1)
        keys += [(word << shift) | x for x in k]
        counts += c
    return keys, counts


def _run(lang: str, words: pa.Array, length: int, subtrees: list[tuple[int, list[int], list[int]]]) -> pa.RecordBatch:
    """A sorted run of some subtrees."""
    sizes = [len(keys) for _, keys, _ in subtrees]
    first = np.repeat(np.array([w for w, _, _ in subtrees], np.int64), sizes)
    rest = np.fromiter(chain.from_iterable(keys for _, keys, _ in subtrees), np.int64, sum(sizes))
    counts = np.fromiter(chain.from_iterable(found for _, _, found in subtrees), np.int64, sum(sizes))
    parts = [rest >> (ID_BITS * i) & ((1 << ID_BITS) - 1) for i in range(max(length - 1, 1))][::-1]
    columns = [words.take(pa.array(c)) for c in ([first] if length > 1 else []) + parts]
    phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if len(columns) > 1 else columns[0]
    order = pc.sort_indices(phrase)
    table = [pa.array([lang] * len(counts)), phrase.take(order).cast(pa.string()), pa.array(counts).take(order)]
    return pa.RecordBatch.from_arrays(table, schema=_RUN)


def _chunks(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Plain texts of one language laid end to end, a few megabytes at a time; cuts are piece breaks (or one long piece)."""
    held, size = [], 0
    for t in texts:
        t = t.translate(_PLAIN)
        start = 0
        while len(t) - start > SLICE_BYTES:
            cut = t.rfind(_BREAK, start, start + SLICE_BYTES)
            cut = t.find(_BREAK, start + SLICE_BYTES) if cut < 0 else cut
            if cut < 0:
                break
            yield t[start:cut]
            start = cut + 1
        held.append(t[start:])
        size += len(held[-1])
        if size > SLICE_BYTES:
            yield _BREAK.join(held)
            held, size = [], 0
    if held:
        yield _BREAK.join(held)


def count_runs(texts: DataFrame, length: int, bloom=None) -> DataFrame:
    """``lang, phrase, f``: sorted runs of phrases of ``length`` words whose halves pass the filter.

    ``texts``: lang, text. For single words there is also one run entry per chunk with an empty phrase: all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tries = WordNumbers(), {}

        def spilled(upto: int) -> Iterator[pa.RecordBatch]:
            total = sum(t.entries for t in tries.values())
            for lang, trie in tries.items():
                held, rows = [], 0
                for subtree in trie.spill(upto * trie.entries // max(total, 1)):
                    held.append(subtree)
                    rows += len(subtree[1])
                    if rows >= RUN_ROWS:
                        yield _run(lang, ids.words, length, held)
                        held, rows = [], 0
                if held:
                    yield _run(lang, ids.words, length, held)

        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs.tolist())):
                mine = batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))
                for chunk in _chunks(t.as_py().encode() for t in mine):
                    a = ids.numbers(chunk)
                    trie = tries.setdefault(lang, PhraseTrie(length))
                    if length == 1:
                        a = a[a > 0]
                        total = pa.array([len(a)])
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), total], schema=_RUN)
                        trie.add(np.zeros(len(a), np.int64), a)
                    else:
                        first, rest = _candidates(a, length, lang, ids.hashes, bloom.value)
                        trie.add(first, rest)
                    if len(ids.words) > MAX_IDS:
                        yield from spilled(0)
                        ids, tries = WordNumbers(), {}
                    elif sum(t.entries for t in tries.values()) > SPILL:
                        yield from spilled(SPILL // 2)
        yield from spilled(0)

    return texts.mapInArrow(run, RUN_SCHEMA)


def _candidates(a: np.ndarray, length: int, lang: str, hashes: np.ndarray, bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and packed rest of every window inside a piece whose two halves pass the filter."""
    n = len(a) - length + 1
    if n <= 0:
        return a[:0], a[:0]
    whole = np.ones(n, bool)
    for k in range(length):
        whole &= a[k : k + n] > 0
    h = hashes[a]
    half = phrase_hash(lang, [h[k : k + n + 1] for k in range(length - 1)])
    ok = _contains(bloom, half)
    at = np.flatnonzero(whole & ok[:n] & ok[1:])
    rest = np.zeros(len(at), np.int64)
    for k in range(1, length):
        rest = (rest << ID_BITS) | a[at + k]
    return a[at], rest


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of at least ``min_count``, and each language's word count (0 words)."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    out, bloom = None, None
    for length in range(1, max_words + 1):
        runs = count_runs(texts, length, bloom)
        # a prefix partition: all runs of phrases with the same first two words, merged by one sum
        if length > 2:
            runs = runs.withColumn("prefix", F.hash("lang", F.substring_index("phrase", " ", 2)))
            merged = runs.repartition("prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("f").alias("f"))
        else:  # the phrase is its own prefix
            merged = runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        kept = merged.filter((F.col("f") >= min_count) | (F.col("phrase") == ""))
        words = F.when(F.col("phrase") == "", 0).otherwise(length)
        table = write_once(kept.select("lang", "phrase", words.alias("words"), "f"), f"phrases-{length}")
        out = table if out is None else out.unionByName(table)
        if length < max_words:
            bloom = spark.sparkContext.broadcast(frequent_filter(table.filter("words > 0")))
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to 4 words."""
    counts = phrase_counts(docs, min_count)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.filter("words > 0").select(key_of("phrase").alias("key"), F.col("f").alias("_f"))
    cands = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    # one row per frequent phrase and cut; adaptive execution splits the partition of a hot part
    cuts = cuts.withColumn("key", key_of("left")).join(parts, "key").withColumnRenamed("_f", "l")
    cuts = cuts.withColumn("key", key_of("right")).join(parts, "key").withColumnRenamed("_f", "r")
    score = F.expr(f"cast(cast(a as decimal(20, 0)) * cast({SCORE_SCALE} as decimal(18, 0)) div cast(l + r as decimal(20, 0)) as bigint)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = (
        counts.filter("words >= 3")
        .select("lang", "f", F.split("phrase", " ").alias("w"))
        .withColumn("size", F.explode(F.expr("sequence(2, size(w) - 1)")))
        .withColumn("i", F.explode(F.expr("sequence(1, size(w) - size + 1)")))
        .select("lang", F.expr("array_join(slice(w, i, size), ' ')").alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVER_PERCENT
    left = worst.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    # the best of every share of a language first: no task sorts all phrases of a language
    ranked = ranked.withColumn("share", F.pmod(F.hash("phrase"), F.lit(RANK_SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def key_of(column: str):
    return F.concat("lang", F.lit("\t"), F.col(column))  # no phrase holds a tab, so the last one separates


ORACLE_SQL = rf"""
WITH texts AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS p FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * {SCORE_SCALE} // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') AND x.words = c.k
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ') AND y.words = c.words - c.k),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS top FROM (
    SELECT lang, f, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM (
      SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(2, words)) AS s FROM f WHERE words >= 3)) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(100 * CAST(top AS HUGEINT) >= {COVER_PERCENT} * CAST(a AS HUGEINT), false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
