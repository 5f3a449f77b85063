"""Quality rules, token counts, packing, secrets: brute force, round trips, odd inputs."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from regweave.llm import packing, quality, secret_scan, token_counts, trees

def small_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_counts_match_brute_force(spark, odd_docs):
    forest = trees.fit(np.zeros((0, len(quality.STATS))), np.zeros(0))
    rows = quality.quality_rules(odd_docs, forest, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = plain_counts(r["text"])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_quality_without_labels_and_without_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.quality_rules(no_docs, quality.fit_quality(no_docs, labels)).count() == 0
    assert quality.quality_rules(odd_docs, quality.fit_quality(odd_docs, labels)).count() == odd_docs.count()


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    forest = trees.fit(x, y, {0: 1, 1: -1})
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.normal(size=(50, 4)), 40, axis=0)
    for j, sign in ((0, 1), (1, -1)):
        moved = grid.copy()
        moved[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(forest.margin(moved).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    knots, level = trees.isotonic(forest.margin(x), y)
    assert (np.diff(level) >= 0).all() and (np.diff(knots) >= 0).all()


def test_quality_stage_keeps_columns_of_any_name(spark, odd_docs, no_docs, sf01):
    named = odd_docs.withColumn("n_words", F.lit(1)).withColumn("quality", F.lit("q")).withColumn("a.b", F.col("row"))
    out = quality.quality_stage(spark, named, sf01)
    assert out.columns == named.columns and {r["_text"] for r in out.collect()} <= {"x", None}
    assert quality.quality_stage(spark, no_docs, sf01).count() == 0


def test_quality_rejects_what_labels_call_bad(spark, sf01):
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.selectExpr("doc_id", "quality AS good")
    got = quality.quality_rules(docs, quality.fit_quality(docs, labels)).join(marks, "doc_id").collect()
    real = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] == bool(r["good"]) for r in real) >= 0.97 * len(real)


def plain_first_fit(sizes, room):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b in bins:
            if sum(sizes[j] for j in b) + sizes[i] <= room:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_tournament_tree_is_first_fit(sizes):
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), 64) == plain_first_fit(sizes, 64)


def test_packing_round_trip(spark, odd_docs, no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    rows = packing.pack_documents(odd_docs).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    want = {}
    for d in odd_docs.select("doc_id", "text").collect():
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [packing.END_ID]
        want.setdefault((d["doc_id"], len(ids)), []).append(np.array(ids, "<u4"))
    cover, sequences = Counter(), {}
    for r in rows:
        ids = want[(r["doc_id"], r["doc_tokens"])][0]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        cover.update((r["doc_id"], r["doc_tokens"], k) for k in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (doc, n), copies in want.items():
        assert all(cover[(doc, n, k)] == len(copies) for k in range(n))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_long_documents_make_smaller_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    docs = spark.createDataFrame([(i, f"word{i} " * 2000) for i in range(30)], "doc_id long, text string")
    groups = {r["sequence_id"] >> 32 for r in packing.pack_documents(docs).collect()}
    assert len(groups) > 10


def test_packing_pads_little():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 5000, 500)
    fill = [sum(p[2] for p in s) for s in packing.pack(lengths)]
    padding = sum(packing.LENGTH - f for f in fill if f & (f - 1))
    assert sum(fill) == lengths.sum() and padding == 0


def test_token_counts_match_brute_force(spark, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    table = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            table[sp.id_to_piece(i).encode()] = sp.get_score(i)
    memo = {}

    def best(word):
        if word not in memo:
            state = [(0.0, 0)]
            for j in range(1, len(word) + 1):
                options = [(state[j - 1][0] + token_counts.FALLBACK, state[j - 1][1] - 1)]
                options += [(state[i][0] + table[word[i:j]], state[i][1] - 1) for i in range(max(0, j - 64), j) if word[i:j] in table]
                state.append(max(options))
            memo[word] = (state[-1][0], -state[-1][1])
        return memo[word]

    assert token_counts.token_counts(no_docs).count() == 0
    small = odd_docs.filter("doc_id <> 5 OR doc_id IS NULL")
    texts = Counter((r["doc_id"], tuple((r["text"] or "").encode().split())) for r in small.collect())
    got = Counter()
    for r in token_counts.token_counts(small).collect():
        words = next(w for d, w in texts if d == r["doc_id"])
        parts = [best(token_counts.MARK + w) for w in words]
        assert r["n_words"] == len(words) and r["n_tokens"] == sum(n for _, n in parts)
        assert r["score"] == pytest.approx(sum(s for s, _ in parts))
        got[(r["doc_id"], words)] += 1
    assert got == texts


KEY = "AKIA" + "ABCDEFGH12345678"
SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize(
    "wrapped",
    [
        base64.b64encode(SECRET.encode()).decode(),
        base64.b64encode(base64.b64encode(SECRET.encode())).decode(),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(),
        base64.b64encode(zstandard.compress(SECRET.encode())).decode(),
        quote(base64.b64encode(SECRET.encode()).decode(), safe=""),
        "".join(f"%{b:02X}" for b in SECRET.encode()),
        "".join(f"%25{b:02X}" for b in SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        "password=" + "".join(f"%{b:02x}" for b in b"hunter2hunter2"),
    ],
)
def test_nested_layers_are_found_in_place(wrapped):
    text = f"é some text {wrapped} and more"
    at = text.index(wrapped)
    spans = [s for s in secret_scan.all_spans(text) if s[1] == 0]
    assert spans and all(at <= s < e <= at + len(wrapped) for s, _, e in spans)
    masked = secret_scan.redacted(text, secret_scan.all_spans(text))
    assert masked.startswith("é some text ") and masked.endswith(" and more") and wrapped not in masked


def wrapped_at(data, width):
    digits = base64.b64encode(data).decode()
    return "\n".join(digits[i : i + width] for i in range(0, len(digits), width))


NOISE = bytes(range(128, 228))


@pytest.mark.parametrize(
    "wrapped",
    [
        wrapped_at(b"." * 50 + SECRET.encode() + b" " * 60, 76),
        wrapped_at(b"." * 40 + SECRET.encode() + b" " * 60, 64).replace("\n", "\r\n  "),
        wrapped_at(gzip.compress(bytes(range(256)) + SECRET.encode()), 64),
        "a/" + base64.b64encode(SECRET.encode()).decode(),
        "file-name_" + base64.b64encode(SECRET.encode() + b" ").decode(),
        "abc/" + base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(NOISE + SECRET.encode() + b"\xff\xfe").decode(),
        base64.b64encode(b"\0\x1b" + SECRET.encode() + b"\0").decode(),
        base64.b64encode(SECRET.encode("utf-16")).decode(),
        base64.b64encode(SECRET.encode("utf-16-be")).decode(),
        "".join(f"%{b:02X}" for b in b"\xff\0" + SECRET.encode() + b"\xfe"),
        "".join(f"%{b:02X}" for b in SECRET.encode("utf-16")),
        quote(gzip.compress(SECRET.encode()), safe=""),
        "".join(f"\\x{b:02x}" for b in zlib.compress(SECRET.encode())),
        repr(gzip.compress(SECRET.encode()))[2:-1],
        base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(b"head" + zlib.compress(gzip.compress(SECRET.encode()))).decode(),
    ],
)
def test_ordinary_carriers_are_opened(wrapped):
    text = f"é some text {wrapped} and more"
    at = text.index(wrapped)
    spans = [s for s in secret_scan.all_spans(text) if s[1] == 0]
    assert spans and all(at <= s < e <= at + len(wrapped) for s, _, e in spans)


def test_exact_offsets_through_percent_and_base64():
    text = "x " + "".join(f"%{b:02x}" for b in f"ab {KEY} cd".encode())
    assert (2 + 9, 1, 2 + 9 + 60) in secret_scan.all_spans(text)
    inner = base64.b64encode(f"abc{KEY}".encode()).decode()
    assert (2 + 4, 1, 2 + len(inner.rstrip("="))) in secret_scan.all_spans(f"x {inner}")


@pytest.mark.parametrize(
    "carrier",
    [
        base64.b64encode(SECRET.encode()).decode(),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zstandard.compress(base64.b64encode(SECRET.encode()))).decode(),
        "".join(f"%{b:02X}" for b in zlib.compress(SECRET.encode())),
        "".join(f"%25{b:02X}" for b in SECRET.encode()),
    ],
)
def test_the_same_carrier_is_opened_wherever_it_stands(carrier):
    text = f"one {carrier} two {carrier}\nthree {carrier}"
    found = secret_scan.all_spans(text)
    for m in re.finditer(re.escape(carrier), text):
        assert any(k == 0 and m.start() <= s < e <= m.end() for s, k, e in found)
    masked = secret_scan.redacted(text, found)
    assert carrier not in masked and "==" not in masked and masked.startswith("one ") and "\nthree " in masked


def test_equal_members_in_one_carrier_are_all_found():
    packed = gzip.compress(SECRET.encode(), mtime=0)
    text = base64.b64encode(packed + b" between " + packed).decode()
    assert len({(s, e) for s, k, e in secret_scan.all_spans(text) if k == 0}) == 2


def test_padding_is_masked_only_where_it_completes_base64():
    digits = base64.b64encode(SECRET.encode() + b"12").decode()
    assert digits.endswith("=") and secret_scan.redacted(f"a {digits} b", secret_scan.all_spans(f"a {digits} b")) == f"a {secret_scan.MASK} b"
    assert secret_scan.redacted(f"{KEY}=x", secret_scan.all_spans(f"{KEY}=x")) == f"{secret_scan.MASK}=x"


def test_frames_without_a_size_are_limited():
    packer = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = b"".join(packer.compress(b" " * (1 << 20)) for _ in range(200)) + packer.flush()
    with pytest.raises(ValueError):
        secret_scan._unzstd(frame)
    assert secret_scan.unpack(frame) is None
    small = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    small = small.compress(SECRET.encode()) + small.flush()
    assert secret_scan.unpack(small + b"tail") == (SECRET.encode(), len(small))


def test_a_content_that_holds_itself_ends(monkeypatch):
    monkeypatch.setattr(secret_scan, "unpack", lambda data: (data, len(data)) if data.startswith(b"BZh") else None)
    assert [c for _, _, c in secret_scan._contents(b"BZh and so on")] == [b"BZh and so on"]


def test_cycles_bombs_and_junk_end():
    assert secret_scan.all_spans("%2525252525" * 50) == []
    bomb = base64.b64encode(zlib.compress(b"a" * (secret_scan.MAX_UNPACKED + 10))).decode()
    assert secret_scan.all_spans(bomb) == []
    assert secret_scan.all_spans("thbleingin onandthereere " * 100) == []


def plain_base(text):
    found = []
    for m in re.finditer(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_scan_matches_brute_force(spark, odd_docs, no_docs, sf01):
    assert secret_scan.secret_scan(no_docs).count() == 0
    assert secret_scan.secret_scan(odd_docs).count() == odd_docs.count()
    texts = ["a" * 30 + "é PASSWORD : 'abc.def-1' " + KEY, "0" * 24, "f" * 23 + "g", "apikey=12345", None, "AKIA token==" + "b" * 9]
    docs = small_docs(spark, texts).unionByName(spark.read.parquet(f"{sf01}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source"))
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs).collect()}
    for d in docs.collect():
        base = plain_base(d["text"] or "")
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(secret_scan.listed(base).encode()).hexdigest()
        assert set(secret_scan.listed(base).split(",")) <= set(r["spans"].split(","))


def test_redaction_keeps_rows_and_columns(spark, odd_docs):
    out = secret_scan.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    row = secret_scan.redact(small_docs(spark, [f"key {KEY} end"])).first()
    assert row["text"] == f"key {secret_scan.MASK} end"
