"""Near-dedup, neighbours, mixing, language, scoring, toxicity and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from regweave.llm import language, lm_score, minhash, mixing, neighbours, toxicity
from regweave.llm import text as T
from regweave.llm.components import components
from regweave.session import materialize


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


def plain_set(text):
    words = tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split())
    if not words:
        return frozenset()
    return frozenset(words[i : i + 5] for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([words])


def plain_classes(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(zip(ids, sets)):
        for j, t in list(zip(ids, sets))[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_copies(seed=3, groups=4, copies=40, words=120):
    """Groups of copies with a few words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    return texts + texts[:25] + ["Short Text", "short text", "", None, "one two three four FIVE", "one two three four five"]


def test_near_duplicates_match_brute_force(spark):
    texts = near_copies()
    want = plain_classes(range(len(texts)), [plain_set(t) for t in texts])
    rows = minhash.near_duplicates(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_shingles"] == len(plain_set(texts[r["doc_id"]]))
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_blocks_find_every_link_across_components(spark, monkeypatch):
    """With no pivot link at all, the block search alone must find every link inside a bucket."""
    texts = near_copies(seed=8, groups=1, copies=60)
    want = plain_classes(range(len(texts)), [plain_set(t) for t in texts])
    monkeypatch.setattr(minhash, "BLOCK", 7)
    real, calls = minhash.confirmed, []

    def only_late(pairs, sets, percent):
        calls.append(1)
        return real(pairs if len(calls) == 3 else pairs.limit(0), sets, percent)

    monkeypatch.setattr(minhash, "confirmed", only_late)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert len(calls) == 3 and got == want


def test_stage_drops_near_copies_down_to_its_threshold(spark):
    """Lone pairs between 0.8 and 0.85 and below 0.8, and chains of copies, against brute force at 0.8."""
    rng = random.Random(12)
    texts = near_copies(seed=5, groups=2, copies=25)
    for _ in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(104)]
        texts.append(" ".join(base))
        for at in rng.sample(range(8, 96, 12), rng.randint(1, 3)):
            base[at] = "changed"
        texts.append(" ".join(base))
    sets = [plain_set(t) for t in texts]
    between = [i for i in range(1, len(texts)) if sets[i] and sets[i - 1] and 80 <= 100 * len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) < 85]
    assert len(between) >= 5
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in minhash.dedup_stage(spark, docs, "").collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}


def test_a_pair_whose_low_bytes_agree_in_an_earlier_band_is_emitted(spark):
    """All low bytes agree, but only band 3 has equal coordinates: its bucket is the only one that holds the pair."""
    sig = np.random.default_rng(2).integers(0, 1 << 20, (2, minhash.COORDS)).astype(np.uint32)
    sig[1] = sig[0] ^ np.uint32(1 << 12)
    third = slice(3 * minhash.ROWS, 4 * minhash.ROWS)
    sig[1, third] = sig[0, third]
    keys, low = minhash.band_keys(sig), (sig & 0xFF).astype(np.uint8)
    assert np.flatnonzero(keys[0] == keys[1]).tolist() == [3]
    rows = [(int(keys[i, 3]), 3, n, n, 10, 100, bytearray(low[i].tobytes()), keys[i].tolist()) for i, n in enumerate((10, 20))]
    schema = "key long, band int, node long, component long, main long, n_shingles long, low binary, bands array<long>"
    got = minhash._blocked_candidates(spark.createDataFrame(rows, schema), 85).collect()
    assert [tuple(r) for r in got] == [(10, 20)]


def test_near_duplicates_of_odd_and_no_rows(spark, odd_docs, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in rows)
    kept = minhash.dedup_stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_texts_of_one_id_are_one_node(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, a), (5, b), (9, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def test_signature_coordinates_are_shifted_minima():
    position = np.array([5, 77, 1 << 20, (1 << minhash.BITS) - 1])
    sig = minhash.signatures(position, np.array([3, 1]))
    size = 1 << minhash.BITS
    pi = np.random.Generator(np.random.PCG64(11)).permutation(size)
    for k in (0, 1, 200, minhash.COORDS - 1):
        assert sig[0, k] == pi[(position[:3] + k) % size].min() and sig[1, k] == pi[(position[3] + k) % size]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2080)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark, monkeypatch):
    """100,000 rising ids, the worst case of moving one step at a time: few steps are stored."""
    import regweave.llm.components as C

    steps, store = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: steps.append(1) or store(df))
    edges = spark.range(100_000).selectExpr("id as a", "id + 1 as b")
    got = components(edges).selectExpr("count(*) as n", "max(component) as c").first()
    assert (got.n, got.c) == (100_001, 0) and len(steps) < 25


def vectors(spark, sf01):
    return spark.read.parquet(f"{sf01}/embeddings.parquet")


def exact_neighbours(pdf, k=5):
    x = np.stack(pdf["embedding"]).astype(float)
    n, ids = np.sqrt((x * x).sum(1)), pdf["vec_id"].to_numpy()
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[i]) / (n * n[i])
        s[i] = -9
        out[int(ids[i])] = [int(v) for v in ids[np.lexsort((ids, -s))[:k]]]
    return out


def test_neighbours_recall_and_scores(spark, sf01):
    df = vectors(spark, sf01)
    pdf = df.toPandas()
    got = neighbours.nearest(df, F.col("vec_id") % 2 == 0).toPandas()
    x = {i: np.asarray(v, float) for i, v in zip(pdf["vec_id"], pdf["embedding"])}
    for r in got.itertuples():
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    want = exact_neighbours(pdf)
    hits = sum(len(set(got[got.query_id == q].vec_id) & set(v)) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().dropna() <= 1e-15).all()


def test_neighbours_of_copies_and_odd_vectors(spark):
    rows = [(50 * i, [1.0, 0.0], 1) for i in range(12)] + [(7, [1.0, 1.0], 1), (8, [0.0, 0.0], 1), (9, [float("nan"), 1.0], 1), (11, None, 1),
            (13, [None, 1.0], 1), (None, [1.0, 0.5], 1), (14, [1.0, 2.0, 3.0], 1), (150, [1e-200, 1e-200], 1), (15, [1e200, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert got[0] == [(15, 1.0), (50, 1.0), (100, 1.0), (150, 1.0), (200, 1.0)]
    assert got[550] == [(0, 1.0), (15, 1.0), (50, 1.0), (100, 1.0), (150, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = df.filter("vec_id IN (0, 7)")
    assert [tuple(r)[:3] for r in neighbours.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 7)]


@pytest.mark.parametrize("rows, dim, distinct", [(2, 8, 2), (4, 32, 4), (6, 64, 6), (10, 384, 10), (30, 16, 3)])
def test_small_tables_give_every_answer(spark, rows, dim, distinct):
    """As many rows as the contract asks for, and the exact ones, where leaves hold too few."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(distinct, dim))
    x = x[np.arange(rows) % distinct]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(rows):
        score = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(rows), -score)) if i != q][:5]
        assert got[q] == want


def test_raking_meets_all_margins(spark):
    rng = np.random.default_rng(1)
    cells = [(f"s{s}" if s else None, lang, t, int(rng.integers(1, 1000))) for s in range(5) for lang in ("en", "de", None) for t in range(3)]
    df = spark.createDataFrame(cells, "_source string, _lang string, _topic long, tokens long")
    sources, lang, topic = mixing.calibrate(df, 0.5)
    a = {r["_source"]: r["a"] for r in sources.collect()}
    weight = {c[:3]: a[c[0]] * lang[c[1]] * topic[c[2]] * c[3] for c in cells}
    for k in range(3):
        total, margin, want = sum(c[3] for c in cells), {}, {}
        for c in cells:
            margin[c[k]] = margin.get(c[k], 0) + weight[c[:3]]
            want[c[k]] = want.get(c[k], 0) + c[3] / total
        want = mixing.tempered(want, 0.5)
        assert all(abs(margin[v] - want[v]) < 1e-5 for v in want)


def test_mixing_samples_to_the_targets(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and max(r["probability"] for r in rows) == 1.0
    assert sum(r["sampled"] for r in rows) >= 0.7 * len(rows)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    expected = sum(r["probability"] for r in rows)
    assert abs(sum(r["sampled"] for r in rows) - expected) < 4 * np.sqrt(expected)
    assert [r["sampled"] for r in mixing.mix_sources(docs).orderBy("doc_id").collect()] == [r["sampled"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_weighted_samples_meet_every_margin(spark):
    """Small sources, languages and topics, whose ratios exceed 1, come out at their targets by the design weight."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        lang = rng.choices(("en", "de", "fi"), (20, 4, 1))[0]
        words = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(rng.randint(5, 40)))
        rows.append((i, words, lang, rng.choices(("big", "mid", "low"), (30, 5, 1))[0]))
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    total, off = sum(r["n_tokens"] for r in got), 0
    for k in ("source", "lang", "topic"):
        seen, due, real, bare = ({} for _ in range(4))
        for r in got:
            v, n = r[k], r["n_tokens"]
            seen[v] = seen.get(v, 0) + n / total
            due[v] = due.get(v, 0) + n / total * r["probability"] * r["design_weight"]
            real[v] = real.get(v, 0) + n / total * r["sampled"] * r["design_weight"]
            bare[v] = bare.get(v, 0) + n * r["sampled"]
        for v, want in mixing.tempered(seen, mixing.TEMPERATURE).items():
            assert abs(due[v] - want) < 1e-4 and abs(real[v] - want) < 0.02
            off = max(off, abs(bare[v] / sum(bare.values()) - want))
    assert off > 1e-3  # without the weight they do not


def test_mixing_of_odd_and_no_rows(spark, odd_docs, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_sources(odd_docs).count() == odd_docs.count()
    assert mixing.mixing_stage(spark, odd_docs, "").columns == odd_docs.columns


def plain_profile(text):
    """Rounded vector of a text, its words hashed one at a time."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    x = [0] * mixing.DIMS
    for w in words:
        t = next(T.slices(pa.array([w.decode()])))[2]
        x[int(t.word_hashes()[0]) >> 56] += 1
    return np.array([round(255 * (c / len(words)) ** 0.5) for c in x] if words else x, float), len(words)


def test_mixing_matches_brute_force(spark):
    """Topics, raking and probabilities against k-means and proportional fitting in plain numpy."""
    rng = random.Random(9)
    rows = []
    for i in range(240):
        theme, lang = rng.randrange(4), rng.choices(("en", "de", None), (6, 2, 1))[0]
        words = " ".join(f"{'abcd'[theme]}{rng.randrange(12)}" for _ in range(rng.randint(3, 30)))
        rows.append((i, words, lang, rng.choices(("big", "low", None), (9, 2, 1))[0]))
    rows += [rows[0]] * 30 + [(900, "", "en", "low"), (901, None, None, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stored = mixing.store_profiles(docs)
    heads = {}
    for r in stored.filter("_tokens > 0").select("x", F.xxhash64("x", F.lit(mixing.SEED)).alias("h")).collect():
        k = r["h"] % mixing.TOPICS
        heads[k] = min(heads.get(k, (r["h"], None)), (r["h"], bytes(r["x"])), key=lambda v: (v[0], v[1] is None))
    scaled = lambda v: np.rint(mixing.UNIT * v / np.linalg.norm(v))
    c = [scaled(np.frombuffer(heads[k][1], np.uint8).astype(float)) for k in sorted(heads)]
    x, n = zip(*(plain_profile(r[1]) for r in rows))
    for _ in range(mixing.ROUNDS):
        at = [int(np.argmax([v @ k for k in c])) for v in x]
        sums = [[x[i] for i in range(len(x)) if at[i] == k and n[i]] for k in range(len(c))]
        c = [scaled(np.sum(s, axis=0)) if s else c[k] for k, s in enumerate(sums)]
    assert np.array_equal(mixing.fit_topics(stored), np.array(c))
    topic = [int(np.argmax([v @ k for k in c])) for v in x]
    cells = {}
    for r, k, m in zip(rows, topic, n):
        if m:
            cells[r[3], r[2], k] = cells.get((r[3], r[2], k), 0) + m
    total = sum(cells.values())
    margins = [{}, {}, {}]
    for key, m in cells.items():
        for part, v in zip(margins, key):
            part[v] = part.get(v, 0) + m / total
    goals = [mixing.tempered(part, mixing.TEMPERATURE) for part in margins]
    fitted = {key: m / total for key, m in cells.items()}
    for _ in range(2000):
        for d in range(3):
            now = {}
            for key, m in fitted.items():
                now[key[d]] = now.get(key[d], 0) + m
            fitted = {key: m * goals[d][key[d]] / now[key[d]] for key, m in fitted.items()}
    got = mixing.mix_sources(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for g in got:
        i = next(i for i, r in enumerate(rows) if r[0] == g["doc_id"])
        assert (g["source"], g["lang"], g["topic"], g["n_tokens"]) == (rows[i][3], rows[i][2], topic[i], n[i])
        key = g["source"], g["lang"], g["topic"]
        if key in cells:
            assert g["probability"] == pytest.approx(min(1.0, fitted[key] / cells[key] * total), abs=1e-4)
        else:
            assert g["probability"] == 1.0
    assert len({g["sampled"] for g in got if g["doc_id"] == 0}) == 1


def held(mod, rest):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def test_language_of_held_out_documents(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    out = language.identify(docs, language.learning_sample(docs, ~held(3, 1)), held(3, 1))
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_matches_brute_force(spark, odd_docs, sf01):
    """The smallest of the outputs of compressors made anew for every text, on driver documents and odd ones."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    learned = language.learning_sample(docs, ~held(3, 1))
    rows = docs.select("doc_id", "text").limit(150).unionByName(odd_docs.select("doc_id", "text")).collect()
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), learned, F.lit(False)).collect()
    setting = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, min_match=language.MIN_MATCH, write_content_size=False)
    want = []
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            want.append((r["doc_id"], "und", 0.0))
            continue
        plain = "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in r["text"])
        data = " ".join("".join(c.lower() if c.isascii() else c for c in plain).split(" ")).encode()
        data = b" ".join(data.split())
        sizes = []
        for name, content in learned.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=setting)
            sizes.append((len(zstandard.ZstdCompressor(dict_data=d, compression_params=setting).compress(data)), len(sizes), name))
        (best, _, name), (second, _, _) = sorted(sizes)[:2]
        want.append((r["doc_id"], name, (second - best) / (second - best + 4.0)))
    order = lambda v: (v[0] is None, v[0] or 0, v[1], v[2])
    found = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got), key=order)
    for a, b in zip(found, sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_language_sample_is_bounded_where_ids_repeat(spark):
    """All rows of one id, or of no id, do not pass the draw together, and copies of a row give one piece."""
    rows = [(i % 2 or None, f"mot{i} numero{i} phrase", "fr") for i in range(4000)] + [(7, "the same row", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learning_sample(docs, F.lit(True), per_language=20)
    assert list(learned) == ["fr"] or learned["en"] == b"the same row"
    assert 10 <= learned["fr"].count(b"phrase") <= 20


def test_language_of_odd_and_no_rows(spark, odd_docs, no_docs):
    learned = language.learning_sample(odd_docs, F.lit(True))
    rows = {r["doc_id"]: r for r in language.identify(odd_docs, learned, F.lit(False)).collect()}
    assert {rows[i]["lang_pred"] for i in (0, 1, 2)} == {"und"} and rows[4]["lang_pred"] == "en"
    assert language.learning_sample(no_docs, F.lit(True)) == {}
    assert language.identify(no_docs, {}, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, {}, F.lit(False)).collect()} == {"und"}


def test_network_gradient_and_scores():
    vocab = lm_score.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    t = next(T.slices(__import__("pyarrow").array(["a b c d e f g", None, "h i"])))[2]
    word, around = lm_score.contexts(t, vocab)
    assert around[0].tolist() == [lm_score.BOUNDARY, lm_score.BOUNDARY, word[1], word[2]]
    assert around[7].tolist() == [lm_score.BOUNDARY, lm_score.BOUNDARY, word[8], lm_score.BOUNDARY]
    flat = lm_score.initial_weights().astype(np.float64)
    loss = lambda w: -lm_score.log_probabilities(lm_score.unpacked(w), word, around).mean()
    moved = flat.copy()
    lm_score.train(lm_score.unpacked(moved), word, around, 1.0)
    grad = flat - moved
    for i in np.argsort(-np.abs(grad))[:20]:
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(grad[i], rel=1e-3)


def test_scoring_learns_and_is_complete(spark, odd_docs, no_docs, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    counts = lm_score.word_counts(docs)
    encoded = lm_score.encode(docs, lm_score.vocabulary(docs, counts), counts)
    mean = lambda w: lm_score.score_documents(encoded, w, counts).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    assert mean(lm_score.fit_network(encoded)) > mean(lm_score.initial_weights()) + 0.1
    rows = lm_score.lm_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["mean_log_prob"] is None) == (r["n_words"] == 0) and r["log_prob"] <= 0 for r in rows)
    assert lm_score.lm_scores(no_docs).count() == 0


def test_every_word_has_its_own_probability(spark, monkeypatch):
    """Words without a class of their own are told apart by their counts, whether tasks hold these or Spark joins them."""
    common = " ".join(f"c{i}" for i in range(lm_score.WORDS))
    texts = [" ".join([common] * 9), *[f"r{i} " * (i % 7 + 1) for i in range(300)], None, "r6 r7 unseen c1"]
    plain = [w for t in texts[:-1] for w in (t or "").split()]
    docs, told = docs_of(spark, texts), docs_of(spark, texts[:-1])
    vocab, weights = lm_score.vocabulary(told), lm_score.initial_weights()
    count = {w: plain.count(w) for w in plain}
    parts = next(T.slices(__import__("pyarrow").array(texts), lower=True))[2]
    word, around = lm_score.contexts(parts, vocab)
    flat = [w for t in texts for w in (t or "").split()]
    mass: dict = {}
    for w, k in {w: k for w, k in zip(flat, word) if w in count}.items():
        mass[k] = mass.get(k, 1) + count[w] + 1
    each = lm_score.log_probabilities(lm_score.unpacked(weights), word, around)
    each = [p + (np.log((count.get(w, 0) + 1) / mass.get(k, 1)) if k >= lm_score.WORDS else 0) for w, k, p in zip(flat, word, each)]
    for head in (0, 40, 65_536):
        monkeypatch.setattr(lm_score, "HEAD", head)
        counts = lm_score.word_counts(told)
        scored = lm_score.score_documents(lm_score.encode(docs, vocab, counts), weights, counts)
        got = {r["doc_id"]: r["log_prob"] for r in scored.collect()}
        at = 0
        for i, t in enumerate(texts):
            n = len((t or "").split())
            assert got[i] == pytest.approx(sum(each[at : at + n]), rel=1e-5, abs=1e-9)
            at += n


def test_every_position_is_trained_on():
    row, place = np.repeat([3, 7 << 40], 140), np.tile(np.arange(140), 2)
    rounds = [lm_score.in_round(row, place, r, lm_score.ROUNDS) for r in range(lm_score.ROUNDS)]
    assert np.sum(rounds, axis=0).tolist() == [1] * 280
    assert all(60 < m.sum() < 130 for m in rounds)


def test_steps_in_blocks_are_whole_gradient_steps():
    """Several steps, blocks and a short last one, against gradients written out over whole batches in double precision."""
    rng = np.random.Generator(np.random.PCG64(4))
    n = 2 * lm_score.BATCH + lm_score.BLOCK + 7
    word, around = rng.integers(0, lm_score.BOUNDARY, n), rng.integers(0, lm_score.CLASSES, (n, 2 * lm_score.SIDE))
    flat = lm_score.initial_weights().astype(np.float64)
    e, w1, b1, w3, b3 = (p.copy() for p in lm_score.unpacked(flat))
    for lo in range(0, n, lm_score.BATCH):
        y, a = word[lo : lo + lm_score.BATCH], around[lo : lo + lm_score.BATCH]
        x = e[a].reshape(len(y), -1)
        h = np.tanh(x @ w1 + b1)
        p = np.exp(h @ w3 + b3)
        p /= p.sum(1, keepdims=True)
        p = (p - np.eye(lm_score.CLASSES)[y]) * (0.5 / len(y))
        dh = (p @ w3.T) * (1 - h * h)
        dx = (dh @ w1.T).reshape(-1, lm_score.EMBED)
        w3, b3, w1, b1 = w3 - h.T @ p, b3 - p.sum(0), w1 - x.T @ dh, b1 - dh.sum(0)
        np.subtract.at(e, a.reshape(-1), dx)
    lm_score.train(lm_score.unpacked(flat), word, around, 0.5)
    for got, want in zip(lm_score.unpacked(flat), (e, w1, b1, w3, b3)):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    h = np.tanh(e[around].reshape(n, -1) @ w1 + b1)
    z = h @ w3 + b3
    want = z[np.arange(n), word] - np.log(np.exp(z).sum(1))
    assert np.allclose(lm_score.log_probabilities(lm_score.unpacked(flat), word, around), want, rtol=1e-9)


def test_class_layer_fits_a_cache():
    """What a step or a score holds at once stays within 512 KB a matrix of class scores, however many positions follow."""
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(4))
    n = 8 * lm_score.BATCH
    word, around = rng.integers(0, lm_score.BOUNDARY, n).astype(np.uint8), rng.integers(0, lm_score.CLASSES, (n, 4)).astype(np.uint8)
    w = lm_score.unpacked(lm_score.initial_weights())
    for run, bound in ((lambda: lm_score.train(w, word, around, 0.5), 1_100_000), (lambda: lm_score.log_probabilities(w, word, around), 600_000)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < bound, peak


def test_lookup_of_hashes():
    rng = np.random.Generator(np.random.PCG64(5))
    close = np.uint64(7 << 60) + np.arange(9, dtype=np.uint64)  # one bucket
    for keys in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(np.concatenate([rng.integers(0, 2**64, 500, np.uint64), close]))):
        asked = np.concatenate([keys, rng.integers(0, 2**64, 500, np.uint64), close + np.uint64(4), np.array([0, 2**64 - 1], np.uint64)])
        at, there = lm_score.Lookup(keys).places(asked)
        assert at.tolist() == np.searchsorted(keys, asked).tolist()
        assert there.tolist() == np.isin(asked, keys).tolist()


def test_contexts_of_picked_positions():
    word, n = np.arange(60, dtype=np.uint8), np.array([0, 20, 1, 0, 39])
    pick = word % 3 == 1
    assert np.array_equal(lm_score._around(word, n, pick), lm_score._around(word, n)[pick])


def test_large_weights_do_not_overflow():
    w = [10 * p for p in lm_score.unpacked(lm_score.initial_weights())]
    w[4][5] = 900
    word = np.array([5, 6])
    with np.errstate(all="raise", under="ignore"):
        got = lm_score.log_probabilities(w, word, np.full((2, 2 * lm_score.SIDE), lm_score.BOUNDARY))
    assert got[0] == pytest.approx(0, abs=1e-3) and -1000 < got[1] < -500


def test_toxicity_of_held_out_documents(spark, sf01):
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, ~held(5, 0))
    rows = toxicity.toxicity(docs, model, held(5, 0)).join(labels, "doc_id").filter("held_out").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == v] for v in (1, 0))
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins >= 0.85 * len(bad) * len(good)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_lexicon_matches_brute_force(spark, sf01):
    """Documents per word and word beginning, counted in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", F.col("toxic").cast("int").alias("y")).dropna(), "doc_id").select("text", "y").collect()
    sampled = spark.createDataFrame(rows, "text string, y int")
    counts = {}
    for r in rows:
        terms = set()
        for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split():
            plain = lambda b: chr(b).isascii() and chr(b).isalnum() or b >= 128
            for _ in range(4):
                w = w[1:] if w and not plain(w[0]) else w
                w = w[:-1] if w and not plain(w[-1]) else w
            if w:
                terms |= {(0, w)} | {(k, w[:k]) for k in toxicity.BEGINNINGS if len(w) > k}
        for t in terms:
            c = counts.setdefault(t, [0, 0])
            c[0 if r["y"] else 1] += 1
    bad = sum(r["y"] for r in rows)
    weight = lambda a, b: np.log((a + 0.5) / (bad + 1)) - np.log((b + 0.5) / (len(rows) - bad + 1))
    want = sorted((a, b) for a, b in counts.values() if a >= toxicity.MIN_TOXIC and weight(a, b) >= toxicity.MIN_WEIGHT)
    got = toxicity.learn_lexicon(sampled)
    assert (got.n_toxic, got.n_other) == (bad, len(rows) - bad) and 0 < len(want) < toxicity.MAX_TERMS
    assert sorted(zip(got.toxic.tolist(), got.other.tolist())) == want


def test_toxicity_of_odd_and_no_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxicity.fit_toxicity(docs, labels)
        rows = toxicity.toxicity(docs, model, F.lit(False)).collect()
        assert len(rows) == docs.count() and all(r["predicted"] == 0 for r in rows)


def test_pipeline_stages_chain(spark, sf01):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == before


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
