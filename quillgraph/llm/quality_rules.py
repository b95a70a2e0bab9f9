"""Quality rules: counts over the whole text, and compression bands.

Zstandard ratios (bytes before by bytes after) of the whole document and of its
fixed chunks must lie in a band that depends on the length compressed: repetitive
text compresses too well, noise hardly at all. Short texts compress worse for
want of context, so their bands are lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm import text as tx

#: (bytes up to, least ratio, highest ratio): the extremes of labelled clean rows at sf0.1 (one fold of four left out;
#: up to 300 bytes their beginnings too) with a margin of 5 %. Few rows have over 20 kB: 10 % there; over 50 kB the
#: extremes are of rows joined by language, with 20 %.
BANDS = (
    (100, 0.78, 1.37), (200, 1.00, 1.68), (300, 1.15, 1.73), (400, 1.27, 1.81), (600, 1.35, 1.93), (1_000, 1.39, 2.05),
    (2_000, 1.63, 2.26), (5_000, 1.82, 2.38), (20_000, 2.03, 2.56), (50_000, 2.12, 2.73), (1 << 62, 1.93, 3.50),
)
#: Bytes of a chunk, and how large a share of the chunks may lie outside the band of their length.
CHUNK, OUTSIDE = 2_048, 0.2
LEVEL = 3
WINDOW = 8
_SYMBOLS = "#*$%&|<>"


def _band(size: int) -> tuple[float, float]:
    return next((low, high) for upto, low, high in BANDS if size <= upto)


def compression(data: bytes, compressor) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside their band (0 for a single chunk).

    The last chunk is joined to the one before it when it is under half as long."""
    if not data:
        return 0.0, 0.0
    whole = len(data) / len(compressor.compress(data))
    if len(data) < 2 * CHUNK:
        return whole, 0.0
    starts = list(range(0, len(data), CHUNK))
    if len(data) - starts[-1] < CHUNK // 2:
        starts.pop()
    outside = 0
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        low, high = _band(b - a)
        outside += not low <= (b - a) / len(compressor.compress(data[a:b])) <= high
    return whole, outside / len(starts)


def accepted(size: int, whole: float, outside: float) -> bool:
    low, high = _band(size)
    return low <= whole <= high and outside <= OUTSIDE


def repeated(h: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in that text."""
    n = len(h)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if n < width:
        return counts
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = tx.windows(h, width)
    starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    key = tx.mixed(key[starts] + owner[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = starts[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return tx.per_text_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), offsets)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunks_outside, base_failed, kept) of every row.

    Null and empty texts have no words and fail. Nothing else of ``docs`` is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                texts = tx.texts_of(part, "text")
                flat, offsets = tx.pure(texts)
                codes, distinct = tx.coded(flat)
                n_words = np.diff(offsets)
                chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
                word_chars = tx.per_text_sum(chars[codes], offsets) if len(codes) else np.zeros(len(n_words), np.int64)
                h = tx.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
                repeats = repeated(h, offsets)
                rows = texts.to_pylist()
                symbols = np.array([sum(map(t.count, _SYMBOLS)) for t in rows], np.int64)
                lines = np.array([repeated_lines(t) for t in rows], np.int64)
                failed = (n_words < min_words) | (100 * repeats > most_repeated * n_words)
                sizes = [len(t.encode()) for t in rows]
                packed = [compression(t.encode(), compressor) for t in rows]
                kept = [not f and accepted(s, *p) for f, s, p in zip(failed, sizes, packed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (n_words, word_chars, symbols, lines, repeats, np.array([p[0] for p in packed]), np.array([p[1] for p in packed]), failed)), pa.array(kept, pa.bool_())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "chunks_outside", "base_failed", "kept"],
                )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("ratio", T.DoubleType()), T.StructField("chunks_outside", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
