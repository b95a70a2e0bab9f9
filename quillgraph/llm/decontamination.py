"""Passages of benchmark items in documents: rare n-gram seeds, then local alignment.

1. Over all documents every n-gram of the items is counted.
2. Of each run of ``SPAN`` neighbouring n-grams of an item the rarest becomes a
   seed, so an unedited stretch of ``SPAN + n - 1`` words always holds one, however
   often the item itself was copied.
3. Each document's n-grams meet the seeds in a hash join (the items are the small
   side: a stated query set, broadcast in blocks of bounded size); hits of an item
   that lie close give a window, and Smith-Waterman alignment of the item with the
   window scores copies, edited ones included.

Documents are read twice and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import text as tx

N = 3
SPAN = 3
#: Points of equal words, of unequal ones, of a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the highest possible score from which an item counts as contained.
LEAST = 0.5
#: Characters of items that are broadcast at once; more items are worked through in blocks.
BLOCK_CHARS = 8 << 20
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def plain_words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the words, offsets of the texts, distinct words: split at white space, lower-cased,
    without signs at either end; what has only signs is left out."""
    lists = pc.utf8_split_whitespace(strings)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, distinct = tx.coded(lists.flatten())
    bare = pc.replace_substring_regex(pc.utf8_lower(distinct), _EDGE, "") if len(distinct) else distinct
    empty = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    if empty.any():
        keep = ~empty[codes]
        codes, owner = codes[keep], owner[keep]
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(counts)), out=offsets[1:])
    return codes, offsets, bare


class Items:
    """The items of a block as word ids, and their n-grams."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.ids, self.n = ids, n
        codes, offsets, words = plain_words(pa.array([t or "" for t in texts], pa.large_string()))
        vocab: dict[str, int] = {}
        to = np.array([vocab.setdefault(w, len(vocab)) for w in words.to_pylist()], np.int64)
        self.words = [to[codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.vocab = pa.array(list(vocab), pa.large_string())
        self.base = len(vocab) + 1
        keys = [self._keys(w) for w in self.words]
        self.grams = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.places = [np.searchsorted(self.grams, k) for k in keys]

    def _keys(self, w: np.ndarray) -> np.ndarray:
        """A number for each n-gram, in mixed radix; words outside the vocabulary never come here."""
        m = len(w) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key = np.zeros(m, np.int64)
        for k in range(self.n):
            key = key * self.base + w[k : k + m] if self.base**self.n < 1 << 62 else tx.mixed((key * 31 + w[k : k + m]).view(np.uint64)).view(np.int64)
        return key

    def hits(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids (-1: in no item) and offsets of the texts; places and n-gram numbers of the items' n-grams."""
        codes, offsets, bare = plain_words(strings)
        if not len(codes) or not len(self.grams):
            return np.full(len(codes), -1), offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = pc.fill_null(pc.index_in(bare, self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        w = to[codes]
        m = len(w) - self.n + 1
        if m <= 0:
            return w, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = w[:m] >= 0
        for k in range(1, self.n):
            ok &= w[k : k + m] >= 0
            cut = offsets[1:-1] - k
            ok[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(ok)
        key = np.zeros(len(at), np.int64)
        for k in range(self.n):
            key = key * self.base + w[at + k] if self.base**self.n < 1 << 62 else tx.mixed((key * 31 + w[at + k]).view(np.uint64)).view(np.int64)
        place = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[place] == key
        return w, offsets, at[hit], place[hit]

    def seeds(self, counts: np.ndarray, span: int) -> dict[int, list[tuple[int, int]]]:
        """Of each run of ``span`` n-grams of an item the rarest (then the first): n-gram number to (item, place)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for item, places in enumerate(self.places):
            chosen = set()
            for a in range(max(1, len(places) - span + 1)) if len(places) else ():
                run = counts[places[a : a + span]]
                chosen.add(a + int(run.argmin()))
            for a in sorted(chosen):
                out.setdefault(int(places[a]), []).append((item, a))
        return out


def alignment(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the place after its last word in the window.

    A row at a time; a run of words left out within a row is a running maximum."""
    m = len(window)
    ramp = np.arange(m + 1) * -GAP
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(m + 1, np.int64)
        np.maximum(row[:-1] + np.where(window == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        if (top := int(new.max())) > best:
            best, end = top, int(new.argmax())
        row = new
    return best, end


def matched(w: np.ndarray, hits: list[tuple[int, int, int]], items: Items, least: float) -> list[tuple[int, float, int]]:
    """(item, score, last word) of the items that one text contains. hits: (item, place in item, place in text)."""
    by: dict[int, list[int]] = {}
    for item, a, at in hits:
        by.setdefault(item, []).append(at - a)
    out = []
    for item, starts in by.items():
        own = items.words[item]
        pad, top = len(own) // 2 + 4, (0, 0)
        starts.sort()
        a = 0
        while a < len(starts):
            b = a
            while b + 1 < len(starts) and starts[b + 1] - starts[b] <= 2 * pad:
                b += 1
            low, high = max(0, starts[a] - pad), min(len(w), starts[b] + len(own) + pad)
            score, end = alignment(own, w[low:high])
            if score > top[0]:
                top = score, low + end
            a = b + 1
        if top[0] >= least * MATCH * len(own):
            out.append((item, top[0] / (MATCH * len(own)), top[1] - 1))
    return out


def _seeded(docs: DataFrame, items: Items, span: int) -> Broadcast:
    """(items, their seeds by how often each n-gram stands in the texts of ``docs``) on the executors."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.grams), np.int64)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                total += np.bincount(held.value.hits(tx.texts_of(part, "text"))[3], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counts = np.zeros(len(items.grams), np.int64)
    # At most one row for each n-gram of the block's items.
    found = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return spark.sparkContext.broadcast((items, items.seeds(counts, span)))


def _contained(strings: pa.Array, own: Items, seed: dict[int, list[tuple[int, int]]], least: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, score, last word) of the items in a slice of texts."""
    is_seed = np.zeros(len(own.grams) + 1, bool)
    is_seed[list(seed)] = True
    w, offsets, at, gram = own.hits(strings)
    good = is_seed[gram]
    at, gram = at[good], gram[good]
    doc = np.searchsorted(offsets, at, side="right") - 1
    by: dict[int, list[tuple[int, int, int]]] = {}
    for d, a, g in zip(doc.tolist(), at.tolist(), gram.tolist(), strict=True):
        by.setdefault(d, []).extend((item, place, a - int(offsets[d])) for item, place in seed[g])
    for d, found in by.items():
        for i, s, e in matched(w[offsets[d] : offsets[d + 1]], found, own, least):
            yield d, i, s, e


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, least: float, n: int, span: int, shortest: int, block_chars: int) -> Iterator[tuple[Broadcast, float]]:
    """The items, by blocks of bounded size and by the number of words of their n-grams, with their seeds."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    chars = items.agg(F.sum(F.length("t") + 32)).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for k in range(blocks):
        rows = (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)).orderBy("i", "t").collect()
        sizes = np.diff(plain_words(pa.array([r["t"] for r in rows], pa.large_string()))[1])
        for m in range(1, n + 1):
            own = [r for r, size in zip(rows, sizes, strict=True) if size >= shortest and (size == m if m < n else size >= n)]
            if own:
                yield _seeded(docs, Items([r["i"] for r in own], [r["t"] for r in own], m), span if m == n else 1), least if m == n else 1.0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, n: int = N, span: int = SPAN, shortest: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, score, last_word) for each row of ``docs`` and item it contains: score is the share of the
    highest alignment score, ``least`` at least; last_word is the place of the last aligned word.

    Items with fewer than ``n`` words count only as they stand, word for word; those with fewer than
    ``shortest`` words (null and empty ones at least) are never contained. Equal items each count. Without
    items, or documents, there are no rows. Repeated rows of ``docs`` each give theirs.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = benchmark.schema[item_col].dataType
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", T.StringType() if isinstance(kind, T.StringType) else T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("last_word", T.LongType())]
    item_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    out = None
    for held, enough in _blocks(texts, benchmark, item_col, item_text, least, n, span, shortest, block_chars):

        def find(batches: Iterator[pa.RecordBatch], held: Broadcast = held, enough: float = enough) -> Iterator[pa.RecordBatch]:
            own, seed = held.value
            for batch in batches:
                row, out = 0, []
                for part in tx.slices(batch, "text"):
                    out += [(row + d, own.ids[i], s, e) for d, i, s, e in _contained(tx.texts_of(part, "text"), own, seed, enough)]
                    row += part.num_rows
                ids = batch.column("doc_id").take(pa.array([x[0] for x in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in out], item_type), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64())], names=["doc_id", "item_id", "score", "last_word"])

        part = texts.mapInArrow(find, T.StructType(fields))
        out = part if out is None else out.unionAll(part)
    out = docs.sparkSession.createDataFrame([], T.StructType(fields)) if out is None else out
    return out.withColumnRenamed("doc_id", id_col).withColumnRenamed("item_id", item_col)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, n: int = N, span: int = SPAN, shortest: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no item (see ``contaminated``). Each row is judged by its own text, with
    whatever id; nothing is shuffled."""
    texts = docs.select(F.col(text_col).alias("text"))
    for held, enough in _blocks(texts, benchmark, item_col, item_text, least, n, span, shortest, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], held: Broadcast = held, enough: float = enough) -> Iterator[pa.RecordBatch]:
            own, seed = held.value
            for batch in batches:
                for part in tx.slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, *_ in _contained(tx.texts_of(part, text_col), own, seed, enough)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
