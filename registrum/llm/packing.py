"""Best-fit packing after dominance reduction.

Bin packing only sees lengths, and there are at most CAP of them, so the plan is made from the histogram of lengths, which
is bounded whatever the number of documents. Reduction in the manner of Martello and Toth fixes bins that dominate every
other bin holding their largest piece: a piece nothing fits beside, a pair that fills the bin, and the largest partner
where no two or no better two pieces fit. The rest is packed best-fit, longest first, in bulk: equal pieces go to equal bins
at once, and each step is a placement (length, first rank, first bin, bins, pieces a bin, offset).

Every piece then finds its place from its rank among pieces of its length. Ranks are counted in salted buckets, so a length
that a third of the documents share is not one task's work.

Defined cases: null text counts as empty and is one piece of id 1; repeated rows are packed as often as they occur, and rows
without a doc_id or with that of another text for their own text; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm.common import batches, doc_texts, documents, release, staged
from registrum.llm.tokens import PieceEncoder, tokenizer_path

CAP = 4096
END_ID = 1
#: Buckets that the pieces of one length are ranked in, at least; as many as the session's shuffles have partitions if more.
SALT = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, cap: int = CAP, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids and end_id: cut only over cap, into cap ids each but the last."""
    last = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator) -> Iterator:
        coder = PieceEncoder(path, lower=True)
        for ids, texts in batches(it, "doc_id", "text"):
            rows = []
            for d, t in zip(ids, texts):
                b = coder.encode(t) + last
                rows += [(d, k, k * cap, len(x) // 4, zlib.crc32(x)) for k in range(-(-len(b) // (4 * cap))) if (x := b[4 * cap * k : 4 * cap * (k + 1)])]
            cols = list(zip(*rows))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del coder
        release()

    return doc_texts(docs).mapInArrow(run, PIECES)


class Plan:
    """Placements of a histogram's pieces; reduced: how many pieces the reduction fixed."""

    def __init__(self, counts: dict[int, int], cap: int = CAP):
        self.cap, self.left, self.used = cap, {s: n for s, n in counts.items() if n}, {}
        if any(not 0 < s <= cap for s in self.left):
            raise ValueError("lengths must be from 1 to cap")
        self.bins, self.placed = 0, []
        self.reduce()
        self.reduced = sum(self.used.values())
        self.best_fit()

    def put(self, size: int, first: int, bins: int, each: int, offset: int) -> None:
        n = bins * each
        self.placed.append((size, self.used.get(size, 0), first, each, offset))
        self.used[size] = self.used.get(size, 0) + n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, size: int, other: int | None) -> None:
        """As many bins of size and other as there are."""
        if other is None:
            m = self.left[size]
            self.put(size, self.bins, m, 1, 0)
        elif other == size:
            m = self.left[size] // 2
            self.put(size, self.bins, m, 2, 0)
        else:
            m = min(self.left[size], self.left[other])
            self.put(size, self.bins, m, 1, 0)
            self.put(other, self.bins, m, 1, size)
        self.bins += m

    def dominating(self, s: int, sizes: list[int]) -> int | None:
        """The partner that s may be fixed with, 0 if s stands alone, None if nothing is proved. sizes: ascending, what is left."""
        room = self.cap - s
        have = lambda x: self.left.get(x, 0) - (x == s)  # noqa: E731  beside the piece itself
        if have(room) > 0:
            return room
        fits = [x for x in sizes[:3] if have(x) > 0]
        if not fits or fits[0] > room:
            return 0
        k = bisect_right(sizes, room) - 1
        while have(sizes[k]) <= 0:
            k -= 1
        small = [x for x in fits for _ in range(min(3, have(x)))][:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return sizes[k]
        if len(small) < 3 or sum(small) > room:  # pairs fit, triples don't: the best pair must not beat the partner
            best, i, j = 0, 0, k
            while i <= j:
                if sizes[i] + sizes[j] > room:
                    j -= 1
                    continue
                if have(sizes[i]) > (i == j) and have(sizes[j]) > 0:
                    best = max(best, sizes[i] + sizes[j])
                i += 1
            if sizes[k] >= best:
                return sizes[k]
        return None

    def reduce(self) -> None:
        again = True
        while again:
            again = False
            for s in sorted(self.left, reverse=True):
                while s in self.left:
                    other = self.dominating(s, sorted(self.left)) if self.left.get(self.cap - s, 0) <= (2 * s == self.cap) else self.cap - s
                    if other is None:
                        break
                    self.fix(s, other or None)
                    again = True

    def best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}
        mask = 0
        for s in sorted(self.left, reverse=True):
            while n := self.left.get(s, 0):
                fit = mask >> s
                if fit:
                    r = s + (fit & -fit).bit_length() - 1
                    first, m = room[r].pop()
                    if not room[r]:
                        mask &= ~(1 << r)
                else:
                    r, first, m = self.cap, self.bins, -(-n // (self.cap // s))
                    self.bins += m
                each = r // s
                full = min(m, n // each)
                spans = [(first, full, each)] if full else []
                if full < m and n - full * each:  # the last pieces share one bin; what is left of the group stays open
                    spans.append((first + full, 1, min(each, n - full * each)))
                filled = 0
                for f, bins, e in spans:
                    self.put(s, f, bins, e, self.cap - r)
                    filled += bins
                    if r - e * s:
                        room.setdefault(r - e * s, []).append((f, bins))
                        mask |= 1 << (r - e * s)
                if filled < m:
                    room.setdefault(r, []).append((first + filled, m - filled))
                    mask |= 1 << r

    def arrays(self) -> dict[str, np.ndarray]:
        """Placements by length and first rank, for a binary search."""
        a = np.array(sorted(self.placed) or [(0, 0, 0, 1, 0)], dtype=np.int64).reshape(-1, 5)
        return {"key": (a[:, 0] << 45) | a[:, 1], "rank": a[:, 1], "first": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: the place of a piece among those of its length, from 0 and gapless."""
    salt = max(SALT, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).cast("int"))
    n = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = n.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return p.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def pack(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """pieces: PIECES. Adds sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap rows
    plan = spark.sparkContext.broadcast(Plan(counts, cap).arrays())

    def run(it: Iterator) -> Iterator:
        a = plan.value
        for b in it:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(a["key"], (size << 45) | rank, side="right") - 1
            q = rank - a["rank"][k]
            out = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out |= {"sequence_id": pa.array(a["first"][k] + q // a["each"][k]), "offset": pa.array(a["offset"][k] + q % a["each"][k] * size)}
            yield pa.record_batch(list(out.values()), names=list(out))

    return ranked(pieces).mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, cap: int = CAP) -> DataFrame:
    return pack(staged(token_pieces(docs, path, cap), "pieces"), cap)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
