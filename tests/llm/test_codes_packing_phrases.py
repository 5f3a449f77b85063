"""Vector codes, best-fit packing and collocations against brute force, and their odd inputs."""

import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from regweave.llm import best_fit, collocations, slice_codes


# -- vector codes ------------------------------------------------------------------------------------------


def brute_codes(rows):
    """rows: (vec_id, vector, label), already valid; the plain form of the training and coding."""
    rows = sorted(rows, key=lambda r: r[0])
    x = np.array([[int(np.floor(4096 * float(c))) for c in v] for _, v, _ in rows], dtype=np.int64)
    w = x.shape[1] // 8
    parts = x.reshape(len(x), 8, w).transpose(1, 0, 2)
    books = parts[:, :16].copy()

    def assign():
        d = ((parts[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(6):
        index, _ = assign()
        for p in range(8):
            for e in range(books.shape[1]):
                mine = parts[p][index[p] == e]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    index, dist = assign()
    codes = {r[0]: ("".join(f"{index[p, i]:02x}" for p in range(8)), int(dist[:, i].sum())) for i, r in enumerate(rows)}
    sums = Counter()
    for r in rows:
        sums[r[2]] += codes[r[0]][1]
    return {r[0]: (*codes[r[0]], sums[r[2]]) for r in rows}, books


def as_vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("n, dims", [(3, 8), (40, 16), (300, 64)])
def test_codes_equal_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(int(i) * 3, [float(v) for v in rng.normal(size=dims).astype(np.float32)], int(i % 4) or None) for i in rng.permutation(n)]
    rows[0] = (rows[0][0], rows[1][1], rows[0][2])
    got = slice_codes.compress(as_vectors(spark, rows)).collect()
    want, books = brute_codes(rows)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {slice_codes.codebook_digest(books)}


def test_slices_are_exact_at_any_spread():
    rng = np.random.default_rng(5)
    for scale in (1, 3, 1000, 1 << 26):
        book = rng.integers(-scale, scale + 1, (16, 5))
        x = rng.integers(-scale, scale + 1, (500, 5))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = slice_codes.Slices(book).nearest(x)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_slices_prune():
    rng = np.random.default_rng(6)
    book = rng.integers(-1000, 1000, (64, 3))
    x = book[rng.integers(0, 64, 200)] + rng.integers(-5, 6, (200, 3))
    s = slice_codes.Slices(book)
    masks = s.candidates(x, s.radius(x))
    assert np.mean([bin(int(m)).count("1") for m in masks]) < 24


def test_codes_of_odd_tables(spark):
    good = [0.5] * 8
    rows = [(1, good, None), (2, None, 1), (3, [float("nan")] * 8, 1), (4, [None] * 8, 1), (5, [float("inf")] + good[1:], 1), (6, [], 1),
            (7, [1.0] * 7, 1), (8, [1.0] * 16, 1), (1, good, 3), (None, [-0.1] * 8, 3), (9, [1e30] * 8, None)]
    got = slice_codes.compress(as_vectors(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 9), (True, 0)]
    assert all(r.error == 0 and r.label_error == 0 for r in got)
    extra = as_vectors(spark, rows[:1]).selectExpr("*", "1 AS v", "2 AS code", "3 AS _group", "4 AS error")
    assert slice_codes.compress(extra).count() == 1
    assert slice_codes.compress(as_vectors(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert slice_codes.compress(as_vectors(spark, [])).count() == 0


# -- best-fit packing ----------------------------------------------------------------------------------------


def fewest_bins(sizes, room):
    """The least number of bins, by search over set partitions into bins."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= room and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def as_counts(sizes, room):
    c = Counter(sizes)
    return [c.get(s, 0) for s in range(room + 1)]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    fixed_any = 0
    for _ in range(150):
        room = int(rng.integers(8, 40))
        sizes = rng.integers(1, room + 1, int(rng.integers(1, 10))).tolist()
        fixed, left = best_fit.reduce_lengths(as_counts(sizes, room), room)
        used = Counter()
        for many, content in fixed:
            assert sum(s * k for s, k in content) <= room
            for s, k in content:
                used[s] += many * k
        rest = [s for s, n in enumerate(left) for _ in range(n)]
        assert used + Counter(rest) == Counter(sizes)
        assert sum(m for m, _ in fixed) + fewest_bins(rest, room) == fewest_bins(sizes, room)
        fixed_any += bool(fixed)
    assert fixed_any > 100


def plain_best_fit(sizes, room):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [(room - b, k) for k, b in enumerate(bins) if b + s <= room]
        if fits:
            bins[min(fits)[1]] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(4)
    for room in (10, 37, 100):
        for n in (1, 5, 60, 400):
            sizes = rng.integers(1, room + 1, n).tolist()
            got = [sum(s * k for s, k in content) for many, content in best_fit.best_fit(as_counts(sizes, room), room) for _ in range(many)]
            assert sorted(got) == plain_best_fit(sizes, room)


def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(best_fit.default_tokenizer())
    tok.encode_special_tokens = True
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def test_packing_is_a_partition_of_all_ids(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = best_fit.pack_best_fit(docs.repartition(5)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, reference_ids(texts.values())))
    seen, sequences, total = Counter(), {}, sum(map(len, ids.values()))
    for r in rows:
        assert r.start == 4096 * r.piece and (r.length == 4096 or r.start + r.length == len(ids[r.doc_id]))
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 2


def test_packing_odd_documents(spark, odd_docs, no_docs):
    rows = best_fit.pack_best_fit(odd_docs).collect()
    whole = reference_ids([r.text for r in odd_docs.collect()])
    assert sum(r.length for r in rows) == sum(map(len, whole))
    assert {r.length for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert any(r.doc_id is None for r in rows)
    assert sum(r.doc_id == 4 for r in rows) == 3
    assert best_fit.pack_best_fit(no_docs).count() == 0


# -- collocations ------------------------------------------------------------------------------------------


def brute_collocations(docs, least, top):
    """docs: (lang, text). The contract as plain loops."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in cands.items():
        lang, w = p[0], p[1:]
        cut = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        inside = [q for q in cands if q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(w)] == w for i in range(len(q) - len(p) + 1))]
        if not any(100 * cands[q] >= 80 * a for q in inside):
            k = cut[1]
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {
        (lang, i + 1): (p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])
    }


def as_texts(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")


def found(df):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    """``small``: containers burst and subtrees spill all the time."""
    rng = np.random.default_rng(8)
    words = ["the", "The", "of", "co", "ab c", "été", "x1", "new", "york", "city"]
    rows = []
    for i in range(60):
        chosen = rng.choice(words, 60, p=[0.3, 0.05, 0.2, 0.1, 0.05, 0.05, 0.05, 0.1, 0.05, 0.05]).tolist()
        marks = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "! "], 60, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03]).tolist()
        rows.append(([None, "en", "de"][i % 3], "".join(itertools.chain(*zip(chosen, marks))) + " new york city" * (i % 4)))
    rows += [("en", None), (None, ""), ("xx", "one"), ("en", " .,\n\t")]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 100 if small else 4 << 20)
    docs = as_texts(spark, rows).repartition(3)
    if small:
        run = collocations.count_runs

        def tiny(texts, length, bloom=None):
            import regweave.llm.collocations as c

            inner = run(_Tiny(texts, c), length, bloom)
            return inner

        monkeypatch.setattr(collocations, "count_runs", tiny)
    got = found(collocations.collocations(docs, min_count=5, top=40))
    want = brute_collocations(rows, 5, 40)
    assert got == want and len(want) > 60


class _Tiny:
    """Runs the counting with tiny limits in the workers."""

    def __init__(self, df, module):
        self.df, self.module = df, module

    def mapInArrow(self, fn, schema):
        def run(batches):
            import regweave.llm.collocations as c

            kept = c.SLICE_BYTES, c.BURST, c.SPILL, c.RUN_ROWS, c.MAX_IDS
            c.SLICE_BYTES, c.BURST, c.SPILL, c.RUN_ROWS, c.MAX_IDS = 100, 4, 30, 8, 12
            try:
                yield from fn(batches)
            finally:
                c.SLICE_BYTES, c.BURST, c.SPILL, c.RUN_ROWS, c.MAX_IDS = kept

        return self.df.mapInArrow(run, schema)


def test_trie_counts_what_it_is_given():
    rng = np.random.default_rng(2)
    for length in (1, 2, 3, 4):
        trie, want = collocations.PhraseTrie(length), Counter()
        old, collocations.BURST = collocations.BURST, 5
        got = Counter()
        for step in range(20):
            grams = rng.zipf(1.5, (200, length)).clip(1, 50)
            want.update(map(tuple, grams.tolist()))
            rest = np.zeros(200, np.int64)
            for k in range(1, length):
                rest = (rest << collocations.ID_BITS) | grams[:, k]
            trie.add(*((grams[:, 0], rest) if length > 1 else (np.zeros(200, np.int64), grams[:, 0])))
            for word, keys, counts in trie.spill(30 if step % 3 == 0 else 10**9 if step < 19 else 0):
                for key, n in zip(keys, counts):
                    shifts = [collocations.ID_BITS * i for i in range(max(length - 1, 1))][::-1]
                    tail = tuple(key >> s & ((1 << collocations.ID_BITS) - 1) for s in shifts)
                    got[tail if length == 1 else (word, *tail)] += n
        collocations.BURST = old
        assert got == want and trie.entries == 0


def test_word_numbers_look_up_distinct_words_once():
    """Numbers as a plain split gives them, over several texts; the dictionary is asked once per distinct word of a text."""
    asked = []

    class Counted(collocations.WordNumbers):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    rng = np.random.default_rng(3)
    ids, plain = Counted(), {b"\xff": 0}
    texts = [b"", b"\xff", b" \xff\xff one", b"one", b"   "]
    texts += [b"".join(rng.choice([b"a", b"bc", "\u00e9".encode(), b"\x01", b"\x1c", b" ", b"  ", b"\xff"], 400)) for _ in range(5)]
    for t in texts:
        asked.clear()
        words = [w for w in t.replace(b"\xff", b" \xff ").split(b" ") if w]
        want = [plain.setdefault(w, len(plain)) for w in words]
        assert ids.numbers(t).tolist() == want
        assert len(asked) <= len(set(words))
    assert ids.words.to_pylist() == [b"", *list(plain)[1:]]
    assert ids.hashes[1:].tolist() == [collocations.xxhash.xxh3_64_intdigest(w) for w in list(plain)[1:]]


def test_ranking_of_one_language_is_shared(spark):
    """A language's phrases are ranked in shares first, and the ranks are those of the whole."""
    rng = np.random.default_rng(6)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 40).tolist())) for _ in range(120)]
    made = collocations.collocations(as_texts(spark, rows), min_count=5, top=30)
    assert found(made) == brute_collocations(rows, 5, 30) and len(found(made)) == 30
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 7_000_000_000_000_000, 8_000_000_000_000_001, 9_000_000_000_000_003
    expr = f"cast(cast(a as decimal(20, 0)) * cast({collocations.SCORE_SCALE} as decimal(18, 0)) div cast(l + r as decimal(20, 0)) as bigint)"
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(expr).first()[0]
    assert got == Fraction(2000000 * a, left + right).__floor__()


def test_collocations_of_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert found(collocations.collocations(odd_docs, min_count=3)) == brute_collocations(rows, 3, 2000)
    assert collocations.collocations(no_docs).count() == 0
