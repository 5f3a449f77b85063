"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a zstandard raw-content dictionary is filled with pieces of a bounded, seeded sample of its
documents. A text is compressed once per dictionary; the smallest output names the language. The gain over
the runner-up, relative to it, is the margin; below ``MIN_MARGIN`` the answer is marked as
rejected (the best guess is still named). Texts and dictionaries are reduced to lower-case letters between single
spaces, so marks, digits and layout do not count.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; with nothing to learn from every
text gives ``und``; ties go to the language with more documents to learn from; repeated rows are judged one by one; an empty
table gives an empty result; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.llm import text as T

#: Documented bounds of the learning sample: languages (those with most documents), documents per language, and
#: characters taken from each (from a seeded place).
LANGUAGES = 512
SAMPLE_DOCS = 128
PIECE = 1024
LEVEL = 7
MIN_MATCH = 3
MIN_MARGIN = 0.002
SEED = 5
UNKNOWN = "und"
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else (i + 32 if 65 <= i <= 90 else 32) for i in range(256))


def reduced(data: bytes) -> bytes:
    return b" ".join(data.translate(_LETTERS).split())


def learning_sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE_DOCS, piece: int = PIECE) -> dict[str, bytes]:
    """Dictionary content per language from the rows that pass ``learn``; at most ``per_language`` pieces each.

    Languages are counted first, then rows are drawn by a seeded hash of id and text with a rate of their language, so
    no language is sorted or gathered in one task. Repeated rows draw alike and give one piece.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    rate = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rate = rate.withColumn("rate", F.lit(2.0 * per_language) / F.col("n"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED + 1)), 11) / F.lit(float(1 << 53))
    place = F.floor(F.greatest(F.length("text") - piece, F.lit(0)) * share)
    drawn = (
        rows.join(F.broadcast(rate), "lang")
        .withColumn("draw", draw)
        .filter(F.col("draw") < F.col("rate"))
        .select("n", "lang", "draw", F.substr("text", (place + 1).cast("int"), F.lit(piece)).alias("piece"))
        .distinct()
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece")))
        .filter(F.col("k") <= per_language)
        .orderBy(F.desc("n"), "lang", "k")
        .collect()
    )
    found: dict[str, list[bytes]] = {}
    for r in drawn:
        found.setdefault(r["lang"], []).append(reduced(r["piece"].encode()))
    return {k: b"\n".join(v) for k, v in found.items()}


def has_letter(t: T.Texts) -> np.ndarray:
    """Texts with an ASCII letter, or with any other character that Unicode calls a letter."""
    sure = t.count(((t.data >= 65) & (t.data <= 90)) | ((t.data >= 97) & (t.data <= 122))) > 0
    for i in np.flatnonzero(~sure & (t.count(t.data >= 0x80) > 0)):
        sure[i] = any(c.isalpha() for c in t.data[t.start[i] : t.end[i]].tobytes().decode("utf-8", "replace"))
    return sure


def identify(docs: DataFrame, dictionaries: dict[str, bytes], held_out: Column, level: int = LEVEL) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, rejected`` of every row."""
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            setting = zstandard.ZstdCompressionParameters.from_level(level, min_match=MIN_MATCH, write_content_size=False)
            d.precompute_compress(compression_params=setting)
            tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=setting))
        for b in batches:
            for lo, hi, t in T.slices(b.column("text")):
                letters = has_letter(t)
                pred, score, margin = [UNKNOWN] * t.n, np.zeros(t.n), np.zeros(t.n)
                for i in np.flatnonzero(letters) if tools else ():
                    data = reduced(t.data[t.start[i] : t.end[i]].tobytes())
                    sizes = np.array([len(c.compress(data)) for c in tools])
                    best = int(sizes.argmin())
                    pred[i] = names[best]
                    second = int(np.delete(sizes, best).min()) if len(sizes) > 1 else len(data) + 1
                    saved = second - int(sizes[best])
                    margin[i] = saved / max(second, 1)
                    score[i] = saved / (saved + 4.0)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(pred), pa.array(score), pa.array(margin),
                     pa.array((margin < MIN_MARGIN) & letters)],
                    ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")
    ).mapInArrow(run, schema)
