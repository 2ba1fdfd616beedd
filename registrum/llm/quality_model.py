"""A quality classifier with supervised subword embeddings.

A word has one vector for itself and one for each of its character n-grams (with marks at its ends), and each pair of
neighbouring words has one; a pair of equal words also has that of its back-reference form, in which a word that repeats the
one before is written as such. All are from one hashed table. A document is the average of its vectors; a softmax over two
classes scores it. Table and output are trained together by stochastic gradient descent in numpy, on the driver, from a bounded
sample of labelled rows (SAMPLE), which is drawn by a hash of doc_id alone. A row's features are at most BUCKETS numbers,
however long its text. Scoring covers all rows: the model is linear in the average, so each word carries one number, kept in a
bounded cache, and each pair one of the table.

Defined cases: null text counts as empty and scores the bias alone; repeated rows stay repeated; rows without a doc_id are
scored, not learned from; of unlike labels of one doc_id the smallest counts, and each of its texts is learned from; extra
columns are ignored; an empty table gives an empty result; without usable labels every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import batches, doc_texts, documents, release

#: Labelled rows that training takes at most, about.
SAMPLE = 4000
BITS, WIDTH = 16, 8
BUCKETS = 1 << BITS
#: An odd number that spreads the names of a pair.
PAIR = 0x9E3779B1
LEAST, MOST = 3, 4
EPOCHS, RATE = 4, 0.5
CACHE = 300_000
THRESHOLD = 0.3


def units(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    w = f"<{word}>"
    grams = [w, *(w[i : i + n] for n in range(LEAST, MOST + 1) for i in range(len(w) - n + 1))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in grams]


def _name(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def pairs(names: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words by their names (uint64)."""
    return (((names[:-1] * np.uint64(PAIR) + names[1:]) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)).astype(np.int64)


#: Bucket of a pair of equal words in its back-reference form.
SAME = _name("\t= =") % BUCKETS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    n: Counter = Counter()
    words = text.split()
    for w, c in Counter(words).items():
        for u in units(w):
            n[u] += c
    n.update(pairs(np.fromiter(map(_name, words), np.uint64, len(words))).tolist())
    if same := sum(map(eq, words, words[1:])):
        n[SAME] += same
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    k, v = np.fromiter(n.keys(), np.int32), np.fromiter(n.values(), np.float32)
    return k, v / v.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number for each bucket, and a bias: the difference of the two classes' logits."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    if len({y for _, _, y in rows}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            k, v, y = rows[r]
            lr = rate * (1 - done / steps)
            done += 1
            h = v @ e[k] if len(k) else np.zeros(WIDTH, np.float32)
            z = w @ h + b
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = g @ w
            w -= lr * np.outer(g, h)
            b -= lr * 0.1 * g
            if len(k):  # the average scales a unit's step by its share; many units make up for it
                e[k] -= (lr * len(k) ** 0.5) * v[:, None] * back[None, :]
    return e @ (w[1] - w[0]), float(b[1] - b[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from labelled rows that aren't held out: all of them, or about sample of them."""
    usable = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = usable.count()
    if n > sample:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * sample / n))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(it: Iterator) -> Iterator:
        for ids, quality, texts, names in batches(it, "doc_id", "quality", "text", "name"):
            f = [features(t) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(names, pa.int64()), pa.array([k for k, _ in f], pa.list_(pa.int32())), pa.array([v for _, v in f], pa.list_(pa.float32()))]
            yield pa.record_batch(cols, names=["doc_id", "quality", "name", "k", "v"])

    d = doc_texts(docs).join(F.broadcast(usable), "doc_id")  # about sample rows of two numbers
    rows = d.select("doc_id", "quality", "text", F.xxhash64("text").alias("name")).mapInArrow(run, "doc_id long, quality int, name long, k array<int>, v array<float>")
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("name", "ascending")])
    cols = [rows.column(c) for c in ("k", "v", "quality")]
    return train([(np.asarray(k.values, np.int32), np.asarray(v.values, np.float32), int(q.as_py() > 0)) for k, v, q in zip(*cols)])


def scored(docs: DataFrame, unit: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(unit.astype(np.float64))

    def run(it: Iterator) -> Iterator:
        table, known = model.value.tolist(), {}

        def look(word: str) -> tuple[float, int, int]:
            u = units(word)
            x = (sum([table[k] for k in u]), len(u), _name(word))
            if len(known) < CACHE:
                known[word] = x
            return x

        for ids, texts in batches(it, "doc_id", "text"):
            out = []
            for t in texts:
                words = t.split()
                z = bias
                if words:
                    value, size, name = zip(*[known.get(w) or look(w) for w in words])
                    two, same = pairs(np.array(name, np.uint64)), sum(map(eq, words, words[1:]))
                    z += (math.fsum(value) + float(model.value[two].sum()) + same * table[SAME]) / (sum(size) + len(two) + same)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])
        known.clear()
        release()

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
