"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is eight segments of eight bits on a ring. If two fingerprints differ in at most 3 bits, the pigeonring
principle gives a segment from which every chain of c consecutive segments has at most 3c/8 differing bits: the first two
segments agree and the three after them differ in one bit at most, so two of those three agree as well. Candidates therefore
share four named segments out of five consecutive ones (24 keys of 32 bits a fingerprint). Each candidate pair is then held
against the budgets of all longer chains, and what they leave against the full distance.

Copies are folded to one row per distinct fingerprint first, and fingerprints, not documents, are linked. In a bucket, pairs are compared in blocks of bounded size and
only a spanning forest of the links leaves it, never all pairs; buckets over BLOCK fingerprints are dealt out as pairs of
blocks, short ones are compared together. Components come from alternating large-star and small-star steps on written tables.

All joins are by shuffle: a planner takes a written table for as large as its compressed file and 24 keys a row for one, and
would send millions of rows through the driver. Aggregates that are joined back are written first, so a hot key's rows can be split.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; repeated rows
stay repeated; unlike texts under one doc_id are rows of their own; rows without a doc_id link like others, and a component
that has none is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import discard, doc_texts, documents, release, staged

#: Differing bits of a link, and words of a shingle.
MOST, WORDS = 3, 3
#: Fingerprints of a block. Larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Fingerprints of a run (a bucket, or two of its blocks) that is compared together with others; most have two.
SHORT = 16
SORTED = ("key", "x", "y", "side", "node", "fp")
SEGMENTS, WIDTH = 8, 8


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits set in over half of the shingles' XXH64 values (seed 42); shingles count as often as they occur."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w])
        whole, starts = b" ".join(w), [0, *ends[: -words].tolist()]
        shingles = [whole[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, *more: str) -> DataFrame:
    """doc_id, fp (signed long) of whole texts, and the named columns."""

    def run(it: Iterator) -> Iterator:
        for b in it:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(fp), *[b.column(c) for c in more]], names=["doc_id", "fp", *more])
        release()

    d = doc_texts(docs, *more)
    return d.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} {d.schema[c].dataType.simpleString()}" for c in more]]))


def _chains(x: np.ndarray) -> np.ndarray:
    """Places in x (differing bits of pairs) for which some segment starts a ring of chains within the proportional budgets."""
    d = np.bitwise_count((x[:, None] >> np.arange(0, 64, WIDTH, dtype=np.uint64)) & np.uint64(255))
    found = np.zeros(len(x), bool)
    for s in range(SEGMENTS):
        live, total = np.flatnonzero(~found), 0
        for c in range(1, SEGMENTS + 1):
            total = total + d[live, (s + c - 1) % SEGMENTS]
            ok = total <= c * MOST // SEGMENTS
            live, total = live[ok], total[ok]
        found[live] = True
    return np.flatnonzero(found)


def _near(x: np.ndarray) -> np.ndarray:
    """Places in x of linked pairs: the chains first, then the full distance."""
    found = _chains(x)
    return found[np.bitwise_count(x[found]) <= MOST]


def _forest(pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of linked pairs of positions, those that join what the ones before have not."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := root.get(i, i)) != i:
            root[i] = i = root.get(j, j)
        return i

    for i, j in pairs:
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield i, j


def _short(fp: np.ndarray, side: np.ndarray, run: np.ndarray) -> Iterator[tuple[int, int]]:
    """Linked pairs of neighbours in the same run, all runs at once: a step for each distance up to the longest run's."""
    for d in range(1, len(run)):
        i = np.flatnonzero(run[d:] == run[:-d])
        if not len(i):
            break
        i = i[(side[i] == 0) | (side[i] != side[i + d])]
        i = i[_near(fp[i] ^ fp[i + d])]
        yield from zip(i.tolist(), (i + d).tolist())


def _long(fp: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Linked pairs of one run: within a block, or between two."""
    own = bool((side == 0).all())
    left, right = (np.arange(len(fp)),) * 2 if own else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if own else right
        yield from ((i, j) for j in others[_near(fp[i] ^ fp[others])].tolist())


def _whole(it: Iterator) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of SORTED and the starts of the runs of one key, x and y in them; no run is cut by the end of a batch."""
    held = None
    for b in it:
        rows = [b.column(c).to_numpy(zero_copy_only=False) for c in SORTED]
        rows = rows if held is None else [np.concatenate(c) for c in zip(held, rows)]
        if not len(rows[0]):
            continue
        starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])]))
        last = starts[-1]
        if last:
            yield [c[:last] for c in rows], starts[:-1]
        held = [c[last:].copy() for c in rows]
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64)


def _links(it: Iterator) -> Iterator:
    """a, b: spanning forests of the links within each run."""
    for (_, _, _, side, node, fp), starts in _whole(it):
        fp, size = fp.view(np.uint64), np.diff(np.concatenate([starts, [len(fp)]]))
        run = np.repeat(np.arange(len(starts)), size)
        short = np.flatnonzero((size[run] > 1) & (size[run] <= SHORT))
        found = [short[list(p)] for p in _forest(_short(fp[short], side[short], run[short]))]
        for k in np.flatnonzero(size > SHORT).tolist():
            of = slice(starts[k], starts[k] + size[k])
            found += [starts[k] + np.array(p) for p in _forest(_long(fp[of], side[of]))]
        ends = np.sort(node[np.array(found, dtype=np.int64).reshape(-1, 2)], axis=1)
        yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])
    release()


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever size the planner takes the tables for."""
    return left.join(right.hint("merge"), on, how)


def keys(fps: DataFrame) -> DataFrame:
    """node, fp, key: 24 keys a fingerprint, each four of five consecutive segments with their place."""
    seg = lambda k: F.shiftrightunsigned("fp", (k % SEGMENTS) * WIDTH).bitwiseAND(F.lit(255))
    out = []
    for i in range(SEGMENTS):
        for left in range(3):
            two = [i + 2 + j for j in range(3) if j != left]
            v = F.lit(i * 3 + left).cast("long")
            for k in (i, i + 1, *two):
                v = F.shiftleft(v, WIDTH).bitwiseOR(seg(k))
            out.append(v)
    return fps.select("node", "fp", F.explode(F.array(*out)).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """fps: node, fp, one row per distinct fp and node. Pairs a < b that join every two linked fingerprints by paths, written."""
    k = keys(fps)
    n = staged(k.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    k = joined(k, n, "key").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    part = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")),
    )
    k = k.select("node", "fp", "key", F.explode(part).alias("p")).select("node", "fp", "key", "p.*")
    k = k.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select(*SORTED)
    out = staged(k.mapInArrow(_links, "a long, b long").distinct(), "links")
    discard(n)
    return out


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, component (smallest node reachable) of every node with a link; edges: a, b."""
    e = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """a > b throughout, written in place of e. Large: neighbours above a node go to its smallest one. Small: those below do."""
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        j = joined(both, least, "a")
        j = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        out = staged(j.filter("a != b").distinct(), "stars")
        discard(e, least)
        return out

    last = None
    for _ in range(most):
        e = star(star(e, True), False)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    d = staged(fingerprints(docs, words), "fingerprints")
    fps = staged(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    edges = links(fps.select(F.col("fp").alias("node"), "fp"))
    groups = components(edges).withColumnRenamed("node", "fp")
    named = staged(joined(fps, groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named-fingerprints")
    least = staged(named.groupBy("component").agg(F.min("first").alias("component_id")), "least-ids")
    ids = staged(joined(named, least, "component").select("fp", "component_id"), "components")
    discard(fps, edges, named, least)
    return joined(d, ids, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
