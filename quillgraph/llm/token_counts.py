"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie with failure links: when no edge fits, the link leads to
the node that stands for what is left after the longest vocabulary entries have
been popped, and a precomputed number says how many those are ("LinMaxMatch";
Song et al., "Fast WordPiece Tokenization", 2021). Only lengths are added up; no
piece is ever built. Equal words of a slice are counted once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm import text as tx

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: What a word ends with in the vocabulary.
WORD_END = "</w>"
#: A vocabulary is broadcast; larger files are refused.
MOST_BYTES = 64 << 20
#: Words whose counts a worker remembers.
REMEMBERED = 200_000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The entries of a tokenizer file (JSON with model.vocab)."""
    import os

    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["model"]["vocab"])


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class Matcher:
    """Counts the pieces of greedy longest match. ``END`` closes a word: alone it is no piece.
    A character that is no piece by itself counts as one where nothing longer fits."""

    END = "\x00"

    def __init__(self, entries: Iterable[str], word_end: str = WORD_END):
        self.next: list[dict[str, int]] = [{}]
        final, depth, parent, letter = [False], [0], [0], [""]
        for entry in entries:
            if word_end and entry.endswith(word_end):
                entry = entry[: -len(word_end)] + self.END
            at = 0
            for c in entry:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    letter.append(c)
                at = to
            final[at] = at > 0
        n = len(self.next)
        #: Where to go on when no edge fits, and the pieces popped on the way.
        self.fail, self.popped = [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            c = letter[v]
            if final[v] or depth[v] == 1:
                self.popped[v] = 0 if depth[v] == 1 and c == self.END else 1
                continue
            z, p = self.fail[parent[v]], self.popped[parent[v]]
            while z and c not in self.next[z]:
                p, z = p + self.popped[z], self.fail[z]
            self.fail[v] = self.next[z].get(c, 0)
            self.popped[v] = p + (not self.fail[v] and c != self.END)

    def count(self, word: str) -> int:
        """Pieces of a word that ends with ``END``."""
        step, fail, popped = self.next, self.fail, self.popped
        total = at = 0
        for c in word:
            to = step[at].get(c)
            while to is None and at:
                total += popped[at]
                at = fail[at]
                to = step[at].get(c)
            if to is None:
                total += c != self.END
            else:
                at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


def counted(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", word_end: str = WORD_END) -> DataFrame:
    """(id, n_words, n_tokens) of every row.

    Texts are lower-cased and cut at white space, then into runs of letters, single
    digits and runs of other signs; vocabulary entries with ``word_end`` fit at their ends only. Null and empty texts
    count 0. Bytes stand for characters as in byte-level vocabularies, so every text
    can be matched.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matcher, split = Matcher(held.value, word_end), regex.compile(_SPLIT).findall
        letters = {b: c for b, c in enumerate(byte_letters())}
        known: dict[str, tuple[int, int]] = {}

        def pieces(word: str) -> tuple[int, int]:
            if (got := known.get(word)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                parts = split(word.lower())
                got = known[word] = (len(parts), sum(matcher.count(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters) + Matcher.END) for p in parts))
            return got

        for batch in batches:
            for part in tx.slices(batch, "text"):
                strings = tx.texts_of(part, "text")
                lists = pc.utf8_split_whitespace(strings)
                codes, distinct = tx.coded(lists.flatten())
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
                each = np.array([pieces(w) for w in distinct.to_pylist()], np.int64).reshape(-1, 2)
                sums = [tx.per_text_sum(each[codes, k], offsets) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, sums)], names=["doc_id", "n_words", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
