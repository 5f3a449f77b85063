"""Secret scans with recursive decoding: every layer of a text is scanned until nothing more can be unwrapped.

A worklist starts with the text itself. Each layer is scanned with the base patterns. Percent-encoding and
character escapes are decoded in place (with their surroundings); base64 runs (also wrapped over lines, and from every
alignment that a separator or a line start gives) become layers of their own. Compressed data is opened wherever it
starts in the bytes that base64, percent or escape runs carry, one member after the other. Bytes that are no clean
UTF-8 are read one character a byte, and once more without NULs (UTF-16 and UTF-32). A layer seen before at the
same place is not opened again, so cycles end; the same carrier at another place is opened there too. Every character
of a layer carries the range of the original text it came from; finds are reported there. Offsets count code points.

Byte-level prefilters over whole slices decide which texts need regular expressions at all; they only skip texts
in which no pattern can match and nothing can be decoded.

Defined cases: null and empty texts have no spans; a find that a decoded layer repeats at the same place is listed
once; data that unpacks to more than ``MAX_UNPACKED`` bytes is taken for a decompression bomb and stays packed;
repeated rows are scanned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.llm import text as T

KINDS = ("assign", "access", "hex")
MAX_UNPACKED = 64 << 20
MASK = "[REMOVED]"
#: Bytes given to the zstandard decoder at a time; a block of 4 bytes can stand for 128 KB.
_ZSTD_STEP = 512
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, and bytes written partly as themselves.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-])+")
ESCAPE_BYTES = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[ -\[\]-~])+""")
_BYTE_OF = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
_ESCAPED_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\.|.", re.DOTALL)
_SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))
_HEXDIGIT = T.table("0123456789abcdefABCDEF")
_HEXLOW = T.table("0123456789abcdef")
_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_B64 = T.table("".join(sorted(_DIGITS)))
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def _readable(data: bytes) -> str | None:
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(out) else out


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts that bytes stand for, with the first and the last byte of every character."""
    if (clean := _readable(data)) is not None:
        first = np.flatnonzero(~T.CONTINUATION[np.frombuffer(data, np.uint8)])
        yield clean, first, np.append(first[1:], len(data)) - 1
        return
    at = np.arange(len(data))
    yield data.decode("latin-1"), at, at
    if b"\0" in data:
        at = np.flatnonzero(np.frombuffer(data, np.uint8))
        yield data.replace(b"\0", b"").decode("latin-1"), at, at


def _unzstd(data: bytes) -> tuple[bytes, int]:
    """One frame; fed in small pieces, since a frame need not say its size and one call has no limit."""
    d, parts, size = zstandard.ZstdDecompressor().decompressobj(), [], 0
    for lo in range(0, len(data), _ZSTD_STEP):
        parts.append(d.decompress(data[lo : lo + _ZSTD_STEP]))
        size += len(parts[-1])
        if size > MAX_UNPACKED:
            raise ValueError("too large")
        if d.eof:
            return b"".join(parts), min(lo + _ZSTD_STEP, len(data)) - len(d.unused_data)
    return b"".join(parts), len(data)


def _limited(make):
    def run(data: bytes) -> tuple[bytes, int]:
        d = make()
        out = d.decompress(data, MAX_UNPACKED + 1)
        if len(out) > MAX_UNPACKED:
            raise ValueError("too large")
        return out, len(data) - len(d.unused_data)

    return run


_PACKED = (
    (b"\x1f\x8b", _limited(lambda: zlib.decompressobj(31))),
    (b"BZh", _limited(bz2.BZ2Decompressor)),
    (b"\xfd7zXZ\x00", _limited(lzma.LZMADecompressor)),
    (b"x\x01", _limited(zlib.decompressobj)),
    (b"x\x5e", _limited(zlib.decompressobj)),
    (b"x\x9c", _limited(zlib.decompressobj)),
    (b"x\xda", _limited(zlib.decompressobj)),
)


_MAGIC = re.compile(rb"\x28\xb5\x2f\xfd|\x1f\x8b|BZh|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")


def _member(data: bytes) -> tuple[bytes, int] | None:
    """The content of the compressed data at the start, and how many bytes it takes; None if there is none."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        try:
            return _unzstd(data)
        except (zstandard.ZstdError, ValueError):
            return None
    for magic, read in _PACKED:
        if data.startswith(magic):
            try:
                return read(data)
            except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
                return None
    return None


def unpack(data: bytes) -> tuple[bytes, int] | None:
    """The content of compressed data and of the members that follow it, and how many bytes they take; or None."""
    got = _member(data)
    if got is None:
        return None
    parts, used = [got[0]], got[1]
    while used < len(data) and (more := _member(data[used:])) is not None and sum(map(len, parts)) + len(more[0]) <= MAX_UNPACKED:
        parts.append(more[0])
        used += more[1]
    return b"".join(parts), used


class _Layer:
    """A text whose characters know the range of the original they came from."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray):
        self.text, self.lo, self.hi = text, lo, hi

    def replaced(self, pattern: re.Pattern, decode) -> _Layer | None:
        """The layer with every decodable match replaced in place; None if nothing changed."""
        parts, lo, hi, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces = decode(m[0])
            if pieces is None:
                continue
            s, e = m.span()
            parts.append(self.text[at:s])
            lo.append(self.lo[at:s])
            hi.append(self.hi[at:s])
            for out, a, b in pieces:
                parts.append(out)
                lo.append(np.full(len(out), self.lo[s + a]))
                hi.append(np.full(len(out), self.hi[s + b - 1]))
            at = e
        if not at:
            return None
        parts.append(self.text[at:])
        return _Layer("".join(parts), np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]]))

    @property
    def key(self) -> tuple[str, int, int]:
        """The same text from the same place is the same layer."""
        return self.text, int(self.lo.min()) if len(self.lo) else 0, int(self.hi.max(initial=0))

    def carried(self, data: bytes, first: np.ndarray, last: np.ndarray, opened: set[tuple]) -> Iterator[_Layer]:
        """Layers of bytes that stand on the characters ``first`` to ``last`` (one of each per byte)."""
        for text, a, z in _readings(data):
            yield _Layer(text, self.lo[first[a]], self.hi[last[z]])
        for s, e, content in _contents(data):
            lo, hi = self.lo[first[s:e]].min(), self.hi[last[s:e]].max()
            if (place := (hashlib.sha256(content).digest(), int(lo), int(hi))) in opened:
                continue
            opened.add(place)
            for text, _, _ in _readings(content):
                yield _Layer(text, np.broadcast_to(lo, len(text)), np.broadcast_to(hi, len(text)))


def _contents(data: bytes, within: set[bytes] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of all compressed data inside ``data``, however often compressed.

    What is nested in one content has the place of its outermost carrier, so there each content comes once
    (``within``); contents at different places of ``data`` all come, equal ones too.
    """
    at = 0
    while (m := _MAGIC.search(data, at)) is not None:
        s, got = m.start(), unpack(data[m.start() :])
        at = s + 1 if got is None else s + max(got[1], 1)
        if got is None or not got[0]:
            continue
        inside = set() if within is None else within
        digest = hashlib.sha256(got[0]).digest()
        if digest in inside:
            continue
        inside.add(digest)
        yield s, at, got[0]
        for _, _, content in _contents(got[0], inside):
            yield s, at, content


def _percent(run: str):
    data = bytes.fromhex(run.replace("%", ""))
    out = _readable(data)
    if out is None:
        return [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(data)]
    pieces, at = [], 0
    for c in out:
        width = 3 * len(c.encode())
        pieces.append((c, at, at + width))
        at += width
    return pieces


def _escape(run: str):
    try:
        if run.startswith("&#"):
            out = html.unescape(run)
            return None if out == run else [(out, 0, len(run))]
        if run[1] in "xU":
            return [(chr(int(run[2:], 16)), 0, len(run))]
        units = [int(u, 16) for u in run.split("\\u")[1:]]
        out = b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be")
    except (ValueError, OverflowError):
        return None
    pieces, at = [], 0
    for c in out:
        width = 12 if ord(c) > 0xFFFF else 6
        pieces.append((c, at, at + width))
        at += width
    return pieces


def _debase(digits: str) -> bytes:
    """Decoded base64 digits without padding; a last digit that gives no whole byte is left out."""
    digits = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def _base64_layers(layer: _Layer, m: re.Match, opened: set[tuple]) -> Iterator[_Layer]:
    run = m[0].rstrip("=")
    inside = np.array([c not in " \t\r\n" for c in run])
    place = np.flatnonzero(inside)
    digits = run if inside.all() else "".join(run.split())
    # whatever starts after a separator or with a line has one of these alignments
    begins = {0} | {(i + 1) % 4 for i, c in enumerate(digits) if c in "+/_-"} | set((np.flatnonzero(np.diff(place) > 1) + 1).tolist())
    for k in sorted({b % 4 for b in begins}):
        data, at = _debase(digits[k:]), m.start() + place[k:]
        if data:
            i = np.arange(len(data))
            last = np.minimum((4 * (i + 1) + 2) // 3, len(at)) - 1
            yield from layer.carried(data, at[4 * i // 3], at[last], opened)


def _byte_run_layers(layer: _Layer, opened: set[tuple]) -> Iterator[_Layer]:
    """What is packed in, or hidden between NULs of, bytes written as percent or escape runs with plain characters between."""
    for mark, runs, one in (("%", PERCENT_BYTES, _BYTE_OF), ("\\x", ESCAPE_BYTES, _ESCAPED_BYTE)):
        if mark not in layer.text:
            continue
        for m in runs.finditer(layer.text):
            if mark not in m[0]:
                continue
            pieces = [(p.start(), p.end(), p[0]) for p in one.finditer(m[0])]
            data = bytes(
                ord(c) if len(c) == 1 else int(c[len(mark) :], 16) if c.startswith(mark) else _SHORT.get(c[1], ord(c[1])) for _, _, c in pieces
            )
            first, last = (m.start() + np.array(v) for v in ([a for a, _, _ in pieces], [z - 1 for _, z, _ in pieces]))
            yield from layer.carried(data, first, last, opened)


def _unwrapped(layer: _Layer, opened: set[tuple]) -> Iterator[_Layer]:
    for pattern, decode in ((PERCENT, _percent), (ESCAPE, _escape)):
        new = layer.replaced(pattern, decode)
        if new is not None:
            yield new
    yield from _byte_run_layers(layer, opened)
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(layer.text):
            yield from _base64_layers(layer, m, opened)


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the text and of everything nested in it, in original offsets: (start, kind index, end)."""
    found = set(base_spans(text))
    at = np.arange(len(text))
    work, opened = [_Layer(text, at, at + 1)], set()
    seen = {work[0].key}
    while work:
        for new in _unwrapped(work.pop(), opened):
            if not new.text or new.key in seen:
                continue
            seen.add(new.key)
            work.append(new)
            for s, kind, e in base_spans(new.text):
                found.add((int(new.lo[s:e].min()), kind, int(new.hi[s:e].max())))
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _runs(mask: np.ndarray, t: T.Texts, least: int) -> np.ndarray:
    """Texts with a run of at least ``least`` set bytes (runs may touch a text end; a longer list does no harm)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    s, e = s[e - s >= least], e[e - s >= least]
    if not len(s):
        return np.zeros(t.n, bool)
    return (np.searchsorted(s, t.end) - np.searchsorted(e, t.start, side="right")) > 0


def _finds(data: bytes, needle: bytes, t: T.Texts, out: np.ndarray) -> None:
    at = data.find(needle)
    while at >= 0:
        doc = int(np.searchsorted(t.end, at, side="right"))
        out[doc] = True
        at = data.find(needle, max(at + 1, int(t.end[doc]) - len(needle)))


def suspects(t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts where a base pattern may match, and texts where something may be decoded."""
    plain, coded = _runs(_HEXLOW[t.raw], t, 24), _runs(_B64[t.raw], t, 16)
    raw, low = t.raw.tobytes(), T.LOWER_MAP[t.raw].tobytes()
    for w in WORDS:
        _finds(low, w, t, plain)
    _finds(raw, b"AKIA", t, plain)
    for w in (b"\\u", b"\\x", b"\\U", b"&#"):
        _finds(raw, w, t, coded)
    at = np.flatnonzero(t.raw[:-2] == 37) if len(t.raw) > 2 else np.zeros(0, np.int64)
    at = at[_HEXDIGIT[t.raw[at + 1]] & _HEXDIGIT[t.raw[at + 2]]]
    coded[np.minimum(np.searchsorted(t.end, at, side="right"), t.n - 1)] = True
    return plain, coded


def _scan(t: T.Texts) -> Iterator[tuple[int, str, list, list]]:
    """(text number, text, base spans, all spans) of the texts that have any span."""
    plain, coded = suspects(t)
    for i in np.flatnonzero(plain | coded):
        text = t.raw[t.start[i] : t.end[i]].tobytes().decode("utf-8", "replace")
        base = base_spans(text) if plain[i] else []
        spans = all_spans(text) if coded[i] else base
        if spans:
            yield int(i), text, base, spans


def secret_scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base finds, a digest of base spans, and all spans of every row of ``docs``."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text")):
                counts = np.zeros((3, t.n), np.int64)
                digest, spans = [nothing] * t.n, [""] * t.n
                for i, _, base, found in _scan(t):
                    counts[:, i] = np.bincount([k for _, k, _ in base], minlength=3)
                    digest[i], spans[i] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _padded(text: str, e: int) -> int:
    """The end of the padding, if a run of base64 digits ends at ``e`` and the signs that follow complete it."""
    if not text.startswith("=", e):
        return e
    signs = 1 + text.startswith("=", e + 1)
    s = e
    while s and text[s - 1] in _DIGITS:
        s -= 1
    return e + signs if s < e and (e - s + signs) % 4 == 0 else e


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every span (overlapping ones joined) replaced, the padding of base64 that ends there included."""
    parts, at = [], 0
    for s, _, e in spans:
        e = _padded(text, e)
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s], mask]
        at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, column: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with secrets masked; all rows and columns stay, and ``n_chars`` (where present) follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            texts = b.column(at)
            changed: dict[int, str] = {}
            for lo, _, t in T.slices(texts):
                changed.update((lo + i, redacted(text, spans, mask)) for i, text, _, spans in _scan(t))
            if changed:
                values = texts.to_pylist()
                for i, v in changed.items():
                    values[i] = v
                b = b.set_column(at, b.schema.field(at), pa.array(values, texts.type))
            yield b

    out = docs.withColumn(column, F.col(column).cast("string")).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length(column), F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; none is dropped."""
    return redact(docs)
