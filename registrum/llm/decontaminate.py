"""Benchmark decontamination: word pairs as seeds, a count filter, then Smith-Waterman alignment.

An alignment scores 2 for equal words, -1 for others and for gaps, as a share of the score of an exact copy. Every pair of
neighbouring words of an item is a seed. One that scores SCORE of m words has at most 2 (1 - SCORE) m other words and gaps,
so its text is at most that much longer than the item, and at least (2 SCORE - 1) m - 1 pairs of the item stand whole in it,
wherever the edits are. Only passages with so many pairs that near each other, and with as many of the item's words as that
score needs, are aligned; for a SCORE over 0.5 the filter loses no alignment that counts.

Test items are read in blocks of at most BLOCK_BYTES of text, each broadcast in turn and read against the corpus in one pass;
a block's seeds are arrays of some 24 bytes a word, so a worker's memory is bounded. A longer item is a block of its own.

Defined cases: null texts and items without words match nothing; each text without an item_id is an item of its own; items of
at most N words are looked up whole; repeated rows stay repeated, and each row is searched for its own text, whatever its
doc_id; extra columns are ignored; empty tables give an empty result; of several places the best, then the first, counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from registrum.llm.common import batches, documents, words

#: Items of at most N words are looked up whole, others by runs of SEED words.
N, SEED = 5, 2
#: Least share of an exact copy's score, and least equal words (or the item's length).
SCORE, EQUAL = 0.6, 8
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 100_000
_P = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], dtype=np.uint64)


class Grams:
    """The seeds of a block of items: hashes of word ids, each with its places."""

    def __init__(self, items: list[tuple[int, str]], n: int = N, score: float = SCORE):
        self.ids, self.vocabulary = [i for i, _ in items], {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t or "")], dtype=np.int64) for _, t in items]
        sizes = [len(w) if len(w) <= n else SEED for w in self.items]
        self.lengths = sorted({*sizes} - {0})
        hashes = [self.hashes(w, size) if len(w) else np.zeros(0, np.uint64) for w, size in zip(self.items, sizes)]
        count = np.array([len(h) for h in hashes], dtype=np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(hashes)), count)[order]
        self.place = (np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count))[order]
        self.hash, first = np.unique(every[order], return_index=True)
        self.first = np.concatenate([first, [len(every)]])
        self.size = m = np.array([len(w) for w in self.items], dtype=np.int64)
        #: The most words other than the item's in an alignment that counts; the least seeds and equal words in one.
        self.gaps = np.floor(2 * (1 - score) * m + 1e-6).astype(np.int64)
        self.need = np.where(m <= n, 1, np.maximum(1, np.ceil((2 * score - 1) * m - 1 - 1e-6))).astype(np.int64)
        self.equal = np.maximum(np.ceil(score * m - 1e-6), np.minimum(EQUAL, m)).astype(np.int64)

    @staticmethod
    def hashes(w: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n words; the length takes part."""
        out = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = out * _P[1] + w[k : len(w) - n + 1 + k].astype(np.uint64)
        return out * _P[2] ^ (out >> np.uint64(29))

    def read(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams and their places in w."""
        found, at = [], []
        for n in self.lengths:
            if len(w) < n or not len(self.hash):
                continue
            known = np.concatenate([[0], np.cumsum(w > 0)])
            full = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(full):
                continue
            h = np.full(len(full), n, dtype=np.uint64)
            for k in range(n):
                h = h * _P[1] + w[full + k].astype(np.uint64)
            h = h * _P[2] ^ (h >> np.uint64(29))
            g = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            ok = self.hash[g] == h
            found.append(g[ok])
            at.append(full[ok])
        return (np.concatenate(found), np.concatenate(at)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def starts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and where in w each would begin, for seeds from which enough of the item's seeds stand near each other."""
        number, at = self.hits(w)
        n = self.first[number + 1] - self.first[number]
        x = np.repeat(self.first[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        k, p, j = self.item[x], np.repeat(at, n), self.place[x]
        order = np.lexsort((p, k))
        k, p, j = k[order], p[order], j[order]
        last = np.arange(len(k)) + self.need[k] - 1
        end = np.minimum(last, len(k) - 1)
        ok = (last == end) & (k[end] == k) & (p[end] - p <= self.size[k] + self.gaps[k])
        k, b = k[ok], p[ok] - j[ok]
        order = np.lexsort((b, k))
        k, b = k[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])])[: len(k)])
        return k[new], b[new]

    def shared(self, k: int, part: np.ndarray) -> int:
        """How many words of item k stand anywhere in part."""
        return int(np.isin(self.items[k], part).sum())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word ids (0 equals nothing): score, equal words, start and end of the best alignment in text.

    Each cell carries where its alignment began and how many words it has equal, so two rows are enough.
    """
    n = len(text)
    j = np.arange(n + 1)
    h, begin, equal = np.zeros(n + 1, np.int64), j.copy(), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, 0)
    for w in item:
        same = (text == w) & (text > 0)
        across, down = h[:-1] + np.where(same, 2, -1), h[1:] - 1
        use = across >= down
        here = np.concatenate([[0], np.maximum(np.where(use, across, down), 0)])
        start = np.concatenate([[0], np.where(use, begin[:-1], begin[1:])])
        count = np.concatenate([[0], np.where(use, equal[:-1] + same, equal[1:])])
        start, count = np.where(here > 0, start, j), np.where(here > 0, count, 0)
        level = np.maximum.accumulate(here + j)
        origin = np.maximum.accumulate(np.where(here + j == level, j, 0))  # the cell to the left that a gap in the item leads from
        h = level - j
        begin, equal = np.where(h > 0, start[origin], j), np.where(h > 0, count[origin], 0)
        k = int(np.argmax(h))
        if h[k] > best[0]:
            best = (int(h[k]), int(equal[k]), int(begin[k]), k)
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items (item_id, text) in blocks of bounded text; the texts of one item_id stay together, each one without an id is an item."""
    block, held = [], 0
    rows = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()
    for i, same in groupby(rows, lambda r: r["item_id"]):
        for item in [list(same)] if i is not None else ([r] for r in same):
            n = sum(len((r["text"] or "").encode("utf-8", "surrogatepass")) for r in item)
            if block and (held + n > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
                yield block
                block, held = [], 0
            block += [(r["item_id"], r["text"]) for r in item]
            held += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, n: int = N, key: str = "doc_id") -> DataFrame:
    """key, item_id, score, n_equal, start_word, end_word of every document row and item it holds a copy of; key names the row."""
    spark = docs.sparkSession
    d = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType
    out = spark.createDataFrame([], schema := f"{key} {kind.simpleString()}, item_id long, score double, n_equal long, start_word long, end_word long")
    for block in _blocks(benchmark):
        grams = spark.sparkContext.broadcast(Grams(block, n, score))

        def run(it: Iterator, grams=grams) -> Iterator:
            g, known = grams.value, {}
            for ids, texts in batches(it, key, "text"):
                rows = []
                for doc, t in zip(ids, texts):
                    rows += [(doc, *x) for x in _aligned(g, g.read(t), score, known)]
                cols = list(zip(*rows)) or [()] * 6
                kinds = [to_arrow_type(kind), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[key, "item_id", "score", "n_equal", "start_word", "end_word"])

        out = out.unionByName(d.mapInArrow(run, schema))
    return out


def _aligned(g: Grams, w: np.ndarray, least: float, known: dict) -> list[tuple]:
    """The best alignment of each item that the seeds point to, if good enough. known: alignments of passages seen before."""
    best, before, last = {}, None, 0
    for k, b in zip(*(x.tolist() for x in g.starts(w))):
        item, gaps = g.items[k], int(g.gaps[k])
        m = len(item)
        if k == before and b - last <= m // 4:
            continue  # the passage read before, with its margins, holds this one
        before, last = k, b
        a, z = max(0, b - gaps), min(len(w), b + m + m // 4 + gaps)
        part = w[a:z]
        if (key := (k, part.tobytes())) not in known:
            if len(known) > 50_000:
                known.clear()
            known[key] = align(item, part) if g.shared(k, part) >= g.equal[k] else (0, 0, 0, 0)
        s, equal, p, q = known[key]
        if s >= 2 * m * least and equal >= min(EQUAL, m) and (k not in best or s > best[k][0]):
            best[k] = (s, equal, a + p, a + q)
    named = {}
    for k, (s, equal, p, q) in sorted(best.items()):
        row = (g.ids[k], s / (2 * len(g.items[k])), equal, p, q)
        name = (k,) if g.ids[k] is None else g.ids[k]
        if name not in named or row[1] > named[name][1]:
            named[name] = row
    return list(named.values())


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
