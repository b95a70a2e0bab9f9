"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Learning sums n-gram counts by language over a bounded sample, on the executors;
the matrix of log probabilities (languages by buckets) is broadcast. Scoring
hashes all n-grams of a slice of texts at once and adds up rows of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import text as tx

#: Buckets of the n-grams; fewer where a matrix of languages by buckets would have over ``ENTRIES`` numbers.
BUCKETS = 1 << 15
ENTRIES = 1 << 24
SIZES = (1, 2, 3)
#: Code points that are worked on at once; a longer text is taken piece by piece.
PIECE = 1 << 18
#: Documents of each language that the counts are taken from, about.
SAMPLE = 1_500
#: More values of the language column than this can't be languages: an error, as none is left out in silence.
LANGUAGES = 1 << 14
#: N-grams that the evidence of a longer text is flattened to for its score.
FLAT = 100.0
UNKNOWN = "und"


def _grams(c: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Buckets of the n-grams that start at each place but the last ones."""
    h = np.full(max(0, len(c) - size + 1), size, np.uint32)
    for k in range(size):
        h = (h ^ c[k : k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)


def _pieces(texts: list[str], piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, leads, joined code points and offsets of lower-cased texts, about ``piece`` code points at once.

    A long text comes in pieces of ``piece`` code points, each after the first led by the last
    ones of the piece before: what lies wholly in the lead has been counted there."""
    rows: list[int] = []
    leads: list[int] = []
    parts: list[np.ndarray] = []
    size, tail = 0, max(SIZES) - 1
    for row, text in enumerate(texts):
        low = text.lower()
        for start in range(0, max(1, len(low)), piece):
            lead = min(start, tail)
            c = np.frombuffer(low[start - lead : start + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
            rows.append(row)
            leads.append(lead)
            parts.append(c)
            size += len(c)
            if size >= piece:
                yield np.array(rows), np.array(leads), np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                rows, leads, parts, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(leads), np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _counted(offsets: np.ndarray, leads: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether the n-gram that starts at a place lies in one text and in no piece before."""
    ok = np.ones(max(0, n - size + 1), bool)
    for k in range(1, size):
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    for k in range(max(SIZES) - size):
        at = offsets[:-1][leads - (size - 1) > k] + k
        ok[at[at < len(ok)]] = False
    return ok


def gram_counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for _, leads, c, offsets in _pieces(texts, PIECE):
        for size in SIZES:
            h = _grams(c, size, buckets)
            total += np.bincount(h[_counted(offsets, leads, size, len(c))], minlength=buckets)
    return total


def log_likelihoods(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: sums of log probabilities by language, and the number of n-grams."""
    out, grams = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), np.int64)
    for rows, leads, c, offsets in _pieces(texts, max(1 << 10, 4 * PIECE // max(4, matrix.shape[1]))):
        for size in SIZES:
            h, ok = _grams(c, size, len(matrix)), _counted(offsets, leads, size, len(c))
            sums = np.zeros((len(h) + 1, matrix.shape[1]))
            np.cumsum(np.where(ok[:, None], matrix[h], 0), axis=0, out=sums[1:])
            count = np.concatenate([[0], np.cumsum(ok)])
            edge = np.minimum(offsets, len(h))
            np.add.at(out, rows, sums[edge[1:]] - sums[edge[:-1]])
            np.add.at(grams, rows, count[edge[1:]] - count[edge[:-1]])
    return out, grams


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by bucket and language, log priors) from the rows with a text and a language.

    Every language that occurs is learned. Of each about ``sample`` rows are taken (all, if there are no
    more), chosen by a hash of the text, with the id if ``id_col`` is given, so that a group of copies counts
    by its share; the priors come from all rows. Nothing to learn from: no languages.
    """
    picked = F.xxhash64("text") if id_col is None else F.xxhash64("text", F.col("id"))
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), *([F.col(id_col).alias("id")] if id_col else [])).filter("lang is not null and text is not null")
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} values of {lang_col}")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    n = {r["lang"]: r["n"] for r in found}
    buckets = BUCKETS
    while buckets * len(languages) > ENTRIES:
        buckets //= 2
    place = docs.sparkSession.createDataFrame([(lang, k, int(min(1.0, sample / n[lang]) * 1_000_000)) for k, lang in enumerate(languages)], "lang string, place int, share int")
    chosen = known.join(F.broadcast(place), "lang").filter(F.pmod(picked, F.lit(1_000_000)) < F.col("share")).select("place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in tx.slices(batch, "text"):
                by: dict[int, list[str]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("place").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    sums[lang] = sums.get(lang, 0) + gram_counts(texts, buckets)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["place", "bucket", "n"])

    counts = np.zeros((buckets, len(languages)))
    summed = chosen.mapInArrow(run, "place int, bucket int, n bigint").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[summed.column("bucket").to_numpy(), summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    smooth = 0.5
    matrix = np.log((counts + smooth) / (counts.sum(0) + smooth * buckets)).astype(np.float32)
    prior = np.array([n[x] for x in languages], float)
    return languages, matrix, np.log(prior / prior.sum())


def judged(texts: list[str], model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score (see ``predicted``)."""
    import regex

    letter = regex.compile(r"\p{L}").search
    languages, matrix, prior = model
    has = np.array([letter(t) is not None for t in texts], bool)
    if not languages or not has.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    like, grams = log_likelihoods(texts, matrix)
    like += prior
    k = like.argmax(1)
    like = (like - like.max(1, keepdims=True)) * np.minimum(1.0, FLAT / np.maximum(grams, 1))[:, None]
    score = 1.0 / np.exp(like).sum(1)
    return [languages[i] if h else UNKNOWN for i, h in zip(k, has, strict=True)], np.where(has, score, 0.0)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its probability appended (columns of these names are replaced).

    The language has the highest sum of log prior and log probabilities of all n-grams. The score is
    its probability when the sums are flattened to at most ``FLAT`` n-grams, so that long mixed texts
    don't look certain. A null text and one without a letter is ``und`` with 0; so is every text if
    nothing was learned. Equal probabilities: the first language by name.
    """
    rest = [f for f in docs.schema if f.name not in names]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text_col):
                best, score = judged([t or "" for t in part.column(text_col).to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*(f.name for f in rest), *names])

    schema = T.StructType([*rest, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, schema)


def confident(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least`` or more."""
    p = predicted(docs, model, text_col, ("__lang", "__score"))
    return p.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
