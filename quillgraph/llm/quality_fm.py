"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of a text's structure, and columns of
metadata (a number by its logarithm, another value by its hash). Pairwise interactions have low rank and are scored in linear time:
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2`` (Rendle, "Factorization
Machines", 2010). The model is fitted with Adagrad on a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import text as tx
from quillgraph.llm.quality_rules import repeated_lines

WORDS = 1 << 13
RANK = 6
#: Labelled rows that are learned from at most, chosen by a hash of the id.
SAMPLE = 4_000
#: Rounds over the sample, rows of a step, step size, pull towards zero.
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.08, 1e-5
STATS = 14


def _stats(text: str, n: int, distinct: float, letters: float) -> list[float]:
    """Statistics of structure. n: words; distinct: share of distinct words; letters: mean word length."""
    size = max(len(text), 1)
    lines = text.count("\n") + 1
    symbols = sum(map(text.count, "#*$%&|<>"))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    digits = sum(map(text.count, "0123456789"))
    stops = text.count(".") + text.count("?")
    shouts = text.count("!")
    return [np.log1p(n) / 8, np.log1p(len(text)) / 10, letters / 10, distinct, min(1.0, 20 * symbols / size), upper / size, lower / size, min(1.0, 10 * digits / size), min(1.0, 30 * stops / size), min(1.0, 30 * shouts / size), min(1.0, 20 * text.count("|") / size), min(1.0, 5 * lines / max(n, 1)), repeated_lines(text) / lines, float(n == 0)]


def _metadata(part: pa.RecordBatch, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and value of each column's feature of each row; a null has the value 0."""
    import xxhash

    ix, vx = np.zeros((part.num_rows, len(columns)), np.int64), np.zeros((part.num_rows, len(columns)))
    for k, name in enumerate(columns):
        for r, v in enumerate(part.column(name).to_pylist()):
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            ix[r, k] = xxhash.xxh64_intdigest(name if v is None or number else f"{name}={v}") % WORDS
            vx[r, k] = 0.0 if v is None or v != v else np.sign(v) * np.log1p(min(abs(v), 1e18)) / 10 if number else 1.0
    return ix, vx


def features(batch: pa.RecordBatch, text: str = "text", metadata: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(offsets, indices, values) of each text by slices: hashed words, the statistics, the metadata."""
    for part in tx.slices(batch, text):
        strings = tx.texts_of(part, text)
        flat, offsets = tx.pure(pc.ascii_lower(strings))
        codes, distinct = tx.coded(flat)
        n = np.diff(offsets)
        bucket = (tx.word_hashes(distinct) % np.uint64(WORDS)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
        length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = tx.per_text_sum(length[codes], offsets) if len(codes) else np.zeros(len(n), np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        key, count = np.unique(owner * WORDS + bucket[codes], return_counts=True) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        who, index, value = key // WORDS, key % WORDS, np.log1p(count)
        norm = np.sqrt(np.bincount(who, value**2, minlength=len(n)))
        value = value / np.maximum(norm[who], 1e-9) if len(who) else value.astype(float)
        kinds = np.bincount(who, minlength=len(n))
        more = STATS + len(metadata)
        ends = np.concatenate([[0], np.cumsum(kinds + more)])
        ix, vx = np.empty(ends[-1], np.int64), np.empty(ends[-1])
        at = np.arange(len(who)) + who * more
        ix[at], vx[at] = index, value
        meta_ix, meta_vx = _metadata(part, metadata)
        for r, t in enumerate(strings.to_pylist()):
            k = ends[r + 1] - more
            ix[k : k + STATS] = np.arange(WORDS, WORDS + STATS)
            vx[k : k + STATS] = _stats(t, int(n[r]), kinds[r] / max(1, n[r]), chars[r] / max(1, n[r]))
            ix[k + STATS : ends[r + 1]], vx[k + STATS : ends[r + 1]] = meta_ix[r], meta_vx[r]
        yield ends, ix, vx


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def margins(self, ends: np.ndarray, ix: np.ndarray, vx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the sums of factors that learning needs. Every text has features."""
        xv = self.factors[ix] * vx[:, None]
        sums = np.add.reduceat(xv, ends[:-1], axis=0)
        squares = np.add.reduceat(xv**2, ends[:-1], axis=0)
        return self.bias + np.add.reduceat(self.linear[ix] * vx, ends[:-1]) + 0.5 * (sums**2 - squares).sum(1), sums

    def score(self, ends: np.ndarray, ix: np.ndarray, vx: np.ndarray) -> np.ndarray:
        if len(ends) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(ends, ix, vx)[0], -40, 40)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted to (indices, values) of each row; without rows it scores 0.5, with one label that label's side."""
    rng = np.random.default_rng(seed)
    p = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(WORDS + STATS), rng.normal(0, 0.02, (WORDS + STATS, RANK)))
    g_bias, g_linear, g_factors = 1e-6, np.full(WORDS + STATS, 1e-6), np.full((WORDS + STATS, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            take = order[start : start + BATCH]
            ends = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in take])])
            ix, vx = np.concatenate([rows[k][0] for k in take]), np.concatenate([rows[k][1] for k in take])
            raw, sums = m.margins(ends, ix, vx)
            off = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[take]) / len(take)
            each = np.repeat(off, np.diff(ends))
            used, back = np.unique(ix, return_inverse=True)
            d_linear = np.bincount(back, each * vx, minlength=len(used)) + DECAY * m.linear[used]
            pull = each[:, None] * vx[:, None] * (np.repeat(sums, np.diff(ends), axis=0) - m.factors[ix] * vx[:, None])
            d_factors = np.stack([np.bincount(back, pull[:, f], minlength=len(used)) for f in range(RANK)], 1) + DECAY * m.factors[used]
            g_bias += off.sum() ** 2
            m.bias -= RATE * off.sum() / np.sqrt(g_bias)
            g_linear[used] += d_linear**2
            m.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            g_factors[used] += d_factors**2
            m.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
    return m


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows of ``docs``. A repeated label of an id counts once, the lowest; null labels don't count.
    ``metadata``: columns of ``docs`` (numbers or texts) that are features too."""
    few = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("__y"))
    few = few.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text"), *metadata).join(F.broadcast(few), id_col).select("text", "__y", *metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for ends, ix, vx in features(batch, metadata=metadata):
                n = len(ends) - 1
                cut = [(ix[a:b], vx[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("__y").slice(row, n), pa.array([c[0] for c in cut], pa.list_(pa.int64())), pa.array([c[1] for c in cut], pa.list_(pa.float64()))], names=["y", "ix", "vx"])
                row += n

    got = rows.mapInArrow(run, "y int, ix array<bigint>, vx array<double>").withColumn("h", F.xxhash64("ix", "vx")).orderBy("h", "y").limit(sample).toArrow()
    ix, vx = got.column("ix").to_pylist(), got.column("vx").to_pylist()
    return fitted([(np.array(a, np.int64), np.array(b)) for a, b in zip(ix, vx, strict=True)], np.array(got.column("y").to_pylist(), float))


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), cutoff: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every row; null and empty texts are scored by their structure and metadata alone.
    ``metadata`` as in learning."""
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*held.value)
        for batch in batches:
            row = 0
            for x in features(batch, metadata=metadata):
                score = m.score(*x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(score)), pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=["doc_id", "score", "predicted"])
                row += len(score)

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *metadata).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
