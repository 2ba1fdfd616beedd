"""Removal of repeated byte strings by external induced suffix sorting.

A window is LENGTH bytes of a document. Each window belongs to its minimizer, the K-byte string of the least hash in it, so
equal windows have equal minimizers at equal places. Windows of one minimizer are dealt, by that place, into ranges of RANGE
neighbours, which share a core of LENGTH - RANGE + 1 bytes: equal windows meet under the core's hash. A core that occurs once
holds no repeat and goes no further; copies of a stretch are folded, and a core with one distinct stretch (a copied passage's
inside) is a repeat throughout. What is left, the edges of copies, is sorted: the distinct stretches of a core go to one shard,
whose suffixes with common prefixes (induced.py) tell every window that some other one equals. Cores with over CAP distinct
stretches, which would be one task's work, are dealt anew by the ranges of SPANS, at last by single windows, in the same way:
what one distinct part has is settled, the rest is sorted, and only the last ranges' groups are sorted whatever their size.

Texts are named by 128 bits of their SHA-256; stretches by two 64-bit hashes of different seeds, core and own, together. One
hash alone tells only what to compare, never that it is equal.

Lists that belong to one text (wanted stretches, spans) are at most as large as the text. Batches leave Python workers by
bytes, so their memory is bounded by FLUSH and the longest text.

Defined cases: null text counts as empty; texts shorter than LENGTH keep all bytes; a repeated row repeats every window of
its text, whatever its doc_id; rows without a doc_id or with that of another text are judged by their text; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from registrum.llm.common import discard, documents, join_paths, release, staged
from registrum.llm.induced import Scratch, _file, suffixes

LENGTH, K, RANGE = 400, 32, 128
#: Ranges of places by which cores over CAP are dealt anew.
SPANS = (16, 1)
#: Distinct stretches of a core that go to one shard at once, and bytes from which a shard is sorted.
CAP, SHARD = 1500, 4 << 20
#: Bytes of a document hashed at once, bytes of text whose rows leave a worker together, and places in one row.
PART, FLUSH, FIRSTS = 1 << 19, 1 << 20, 1024
_POS = np.uint64((1 << 20) - 1)
NODE = "blob binary, core long, seg long, place int, m int, firsts array<int>, n long"
RUNS = "core long, seg long, start int, m int"


def _minimizers(b: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window's minimizer and the window's starts, over b (at most 1 << 20 bytes)."""
    h, p, done, todo = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1, k
    power = p
    while done < todo:  # k is a power of two
        h = h[:-done] * np.uint64(power) + h[done:]
        power = power * power % (1 << 64)
        done *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    w, done, low = length - k + 1, 1, key
    while 2 * done <= w:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if w > done:
        low = np.minimum(low[: len(key) - w + 1], low[w - done : w - done + len(key) - w + 1])
    at = (low & _POS).astype(np.int64)
    return at, np.arange(len(at))


def _core(text: bytes, at: int, q: int, span: int, length: int, k: int) -> int:
    """Hash of what the windows of places q * span ... share, at: place of the minimizer in text."""
    far = min(q * span + span - 1, length - k)
    return xxhash.xxh3_64_intdigest(text[at - q * span : at - far + length], seed=q) - (1 << 63)


def _seg(text: bytes, place: int, m: int, length: int) -> int:
    """Hash of m windows of which the first is text's start; its minimizer's place takes part."""
    return xxhash.xxh3_64_intdigest(text[: m - 1 + length], seed=place * 1024 + m) - (1 << 63)


def nodes(text: bytes, length: int = LENGTH, k: int = K, span: int = RANGE) -> Iterator[dict[tuple[int, int, int, int], list[int]]]:
    """core, seg, place, windows of each stretch of windows with one minimizer and range of places, by parts of text: where it starts."""
    size = min(PART, (1 << 20) - length)
    for base in range(0, len(text) - length + 1, size):
        out: dict[tuple[int, int, int, int], list[int]] = defaultdict(list)
        part = text[base : base + size + length - 1]
        at, s = _minimizers(np.frombuffer(part, np.uint8), length, k)
        bucket = (at - s) // span
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1])]))
        ends = np.concatenate([cut[1:], [len(s)]])
        for x, y, p, g in zip(cut.tolist(), ends.tolist(), at[cut].tolist(), bucket[cut].tolist()):
            core = _core(part, p, g, span, length, k)
            seg = _seg(part[x : y - 1 + length], p - x, y - x, length)
            out[core, seg, p - x, y - x].append(base + x)
        yield out


def _texts(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", t.cast("binary").alias("text"), F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("blob"))


def _mapped(df: DataFrame, rows, schema: str) -> DataFrame:
    """rows(batch) gives tuples of schema, each with the bytes it stands for; they leave by FLUSH bytes."""
    kind = _parse_datatype_string(schema)
    names, kinds = kind.names, [to_arrow_type(f.dataType) for f in kind.fields]

    def batch(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    def run(it: Iterator) -> Iterator:
        out, held = [], 0
        for b in it:
            for row, size in rows(b):
                out.append(row)
                held += size
                if held > FLUSH:
                    yield batch(out)
                    out, held = [], 0
        yield batch(out)
        out = None
        release()

    return df.mapInArrow(run, schema)


def _nodes(texts: DataFrame, length: int) -> DataFrame:
    """Nodes of the distinct texts within a batch with n, how often they occur in it."""

    def rows(b: pa.RecordBatch) -> Iterator:
        blobs = b.column("blob").to_pylist()
        n, seen = Counter(blobs), set()
        for blob, t in zip(blobs, b.column("text")):
            if blob in seen:
                continue
            seen.add(blob)
            for part in nodes(t.as_py(), length):
                for key, firsts in part.items():
                    for k in range(0, len(firsts), FIRSTS):
                        few = firsts[k : k + FIRSTS]
                        yield (blob, *key, few, n[blob] * len(few)), 64 * len(few)

    return _mapped(texts, rows, NODE)


class Shard:
    """Stretches that one sort compares; their text goes to a file as they come."""

    def __init__(self):
        self.file, self.rows, self.size = _file(), [], 0

    def add(self, core: int, seg: int, n: int, m: int, text: bytes) -> None:
        x = np.frombuffer(text, np.uint8).astype(np.uint16)
        x += 1  # 0 parts the stretches
        self.file.write(x.tobytes() + b"\0\0")
        self.rows.append((core, seg, n, m, self.size))
        self.size += len(text) + 1

    def runs(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """core, seg, from, windows of each run of repeated windows."""
        if not self.rows:
            return
        self.file.flush()
        scratch = Scratch()
        hit, last = scratch.array(self.size, np.bool_), 0
        for pos, lcp in suffixes(np.memmap(self.file, np.uint16, "r", shape=(self.size,)), length, scratch=scratch):
            same = np.flatnonzero(lcp >= length)  # with the entry before
            hit[pos[same]] = True
            hit[np.concatenate([[last], pos[:-1]])[same]] = True
            last = int(pos[-1])
        for core, seg, n, m, s in self.rows:
            h = np.ones(m, bool) if n > 1 else hit[s : s + m]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], h.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                yield core, seg, a, b - a
        self.file.close()


def _sorted(stretches: DataFrame, length: int) -> DataFrame:
    """RUNS of repeated windows; stretches: core, seg, n, m, text, distinct by core and seg."""

    def run(it: Iterator) -> Iterator:
        shard, core = Shard(), None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

        def sort() -> Iterator:
            runs = list(shard.runs(length))
            for k in range(0, len(runs), 1 << 16):
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*runs[k : k + (1 << 16)]), kinds)], names=["core", "seg", "start", "m"])

        for b in it:
            for c, seg, n, m, t in zip(*(b.column(k) for k in ("core", "seg", "n", "m", "text"))):
                c = c.as_py()
                if c != core and shard.size > SHARD:
                    yield from sort()
                    shard = Shard()
                core = c
                shard.add(c, seg.as_py(), n.as_py(), m.as_py(), t.as_py())
        yield from sort()
        shard = None
        release()

    return stretches.repartition("core").sortWithinPartitions("core", "seg").select("core", "seg", "n", "m", "text").mapInArrow(run, RUNS)


def _settled(stretches: DataFrame, length: int, cap: int, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """RUNS of repeated windows; stretches: core, seg, n, hot (whether the core has over cap of them), place, m, text."""
    runs = _sorted(stretches.filter("not hot"), length)
    hot = stretches.filter("hot").drop("hot")
    return runs if hot.isEmpty() else runs.unionByName(_dealt(hot, length, cap, spans))


def _dealt(stretches: DataFrame, length: int, cap: int, spans: tuple[int, ...], k: int = K) -> DataFrame:
    """The same for stretches of hot cores: dealt anew by ranges of spans[0] places."""
    span, rest = spans[0], spans[1:]

    def part(b: pa.RecordBatch) -> Iterator:
        for c, seg, n, p, m, t in zip(*(b.column(x).to_pylist() for x in ("core", "seg", "n", "place", "m", "text"))):
            for q in range((p - m + 1) // span, p // span + 1):
                a, z = max(0, p - q * span - span + 1), min(m, p - q * span + 1)  # windows of this range: places p - a ... p - z + 1
                yield (c, seg, a, z - a, p - a, _core(t, p, q, span, length, k), _seg(t[a : z - 1 + length], p - a, z - a, length), n), 64

    parts = staged(_mapped(stretches.select("core", "seg", "n", "place", "m", "text"), part, "core long, seg long, start int, m int, place int, fine long, part long, n long"), "parts")
    one = staged(parts.groupBy("fine", "part").agg(F.sum("n").alias("n"), F.min(F.struct("core", "seg", "start", "m", "place")).alias("x")).select("fine", "part", "n", "x.*"), "distinct-parts")
    met = staged(one.groupBy("fine").agg(F.sum("n").alias("times"), F.count("*").alias("kinds")).filter("times > 1").select("fine", "kinds"), "parts-met")
    sure = parts.join(met.filter("kinds = 1"), "fine").select("core", "seg", "start", "m")
    hot = F.col("kinds") > F.lit(cap if rest else 1 << 62)
    want = one.join(met.filter("kinds > 1"), "fine").groupBy("core", "seg").agg(F.collect_list(F.struct("fine", "part", "n", hot.alias("hot"), "place", "m", "start")).alias("want"))

    def cut(b: pa.RecordBatch) -> Iterator:
        for t, want in zip(b.column("text"), b.column("want")):
            t = t.as_py()
            for w in want.as_py():
                text = t[w["start"] : w["start"] + w["m"] - 1 + length]
                yield (w["fine"], w["part"], w["n"], w["hot"], w["place"], w["m"], text), len(text)

    pieces = staged(_mapped(stretches.join(want, ["core", "seg"]).select("text", "want"), cut, "core long, seg long, n long, hot boolean, place int, m int, text binary"), "parts-cut")
    fine = _settled(pieces, length, cap, rest).select(F.col("core").alias("fine"), F.col("seg").alias("part"), F.col("start").alias("more"), F.col("m").alias("windows"))
    found = parts.join(fine, ["fine", "part"]).select("core", "seg", (F.col("start") + F.col("more")).alias("start"), F.col("windows").alias("m"))
    return sure.unionByName(found)


def repeated(docs: DataFrame, length: int = LENGTH, cap: int = CAP) -> DataFrame:
    """blob, spans (first window, windows) of every distinct text that has repeated windows."""
    texts = _texts(docs)
    all_nodes = staged(_nodes(texts.select("blob", "text"), length), "nodes")
    # aggregates that are joined back are written first: a join of two plain reads can split a hot core's rows
    per = all_nodes.groupBy("core").agg(F.sum("n").alias("times"), (F.min("seg") == F.max("seg")).alias("same")).filter("times > 1")
    cores = staged(per.select("core", "same"), "cores")
    met = staged(all_nodes.join(cores, "core"), "met")
    discard(all_nodes, cores)
    mixed = met.filter("not same")
    one = mixed.groupBy("core", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("blob", F.get("firsts", F.lit(0)).alias("first"), "place", "m")).alias("x"))
    one = staged(one.select("core", "seg", "n", "x.*"), "distinct-stretches")
    hot = staged(one.groupBy("core").agg(F.count("*").alias("distinct")).filter(F.col("distinct") > cap).select("core", F.lit(True).alias("hot")), "hot-cores")
    wanted = one.join(hot, "core", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = wanted.groupBy("blob").agg(F.collect_list(F.struct("core", "seg", "n", "hot", "first", "place", "m")).alias("want"))
    holder = texts.select("doc_id", "blob").groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(holder, "blob").select("doc_id", "blob", "want")

    def cut(b: pa.RecordBatch) -> Iterator:
        for t, want in zip(b.column("text"), b.column("want")):
            t = t.as_py()
            for w in want.as_py():
                text = t[w["first"] : w["first"] + w["m"] - 1 + length]
                yield (w["core"], w["seg"], w["n"], w["hot"], w["place"], w["m"], text), len(text)

    pieces = _mapped(join_paths(texts, wanted).select("text", "want"), cut, "core long, seg long, n long, hot boolean, place int, m int, text binary")
    pieces = staged(pieces.dropDuplicates(["core", "seg"]), "stretches")
    runs = staged(_settled(pieces, length, cap), "runs")
    found = mixed.select("core", "seg", "blob", F.explode("firsts").alias("first")).join(runs, ["core", "seg"]).select("blob", (F.col("first") + F.col("start")).alias("first"), "m")
    sure = met.filter("same").select("blob", F.explode("firsts").alias("first"), "m")
    spans = staged(sure.unionByName(found).groupBy("blob").agg(F.collect_set(F.struct("first", "m")).alias("spans")), "repeats")
    discard(met, one, hot, pieces, runs)
    return spans


def strip(docs: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""

    def rows(b: pa.RecordBatch) -> Iterator:
        for d, t, ss in zip(*(b.column(k) for k in ("doc_id", "text", "spans"))):
            t, kept, at, removed, n = t.as_py(), [], 0, 0, 0
            for s in sorted(ss.as_py() or [], key=lambda s: s["first"]):
                a, z = s["first"], s["first"] + s["m"] - 1 + length
                if n == 0 or a > at:
                    kept.append(t[at:a])
                    n, removed, at = n + 1, removed + z - a, z
                elif z > at:
                    removed, at = removed + z - at, z
            yield (d.as_py(), len(t), removed, n, b"".join(kept) + t[at:]), len(t)

    t = _texts(docs)
    ids = t.select("doc_id", "blob").distinct().join(spans, "blob").select("doc_id", "blob", "spans")
    return _mapped(join_paths(t, ids, "left").select("doc_id", "text", "spans"), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return strip(docs, repeated(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text by its MD5, islands of repeated windows, and the bytes between them.
OP10_SQL = f"""
with d as (select row_number() over () rid, doc_id, encode(coalesce(text, '')) b from documents),
n as (select *, octet_length(b) n from d),
w as (select rid, i, md5(b[i + 1:i + {LENGTH}]) k from (select rid, b, unnest(range(0, greatest(0, n - {LENGTH} + 1))) i from n)),
r as (select rid, i from w where k in (select k from w group by k having count(*) > 1)),
s as (select rid, i, coalesce(i - lag(i) over o > {LENGTH}, true)::int fresh from r window o as (partition by rid order by i)),
g as (select rid, i, sum(fresh) over (partition by rid order by i rows unbounded preceding) run from s),
x as (select rid, run, min(i) a, max(i) + {LENGTH} z from g group by rid, run),
y as (select rid, a, z, lag(z, 1, 0) over (partition by rid order by a) p from x),
k as (select rid, sum(z - a) removed, count(*) spans, max(z) tail, string_agg(hex(b[p + 1:a]), '' order by a) kept from y join n using (rid) group by rid)
select doc_id, n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(tail, 0) + 1:]))) kept_sha256 from n left join k using (rid)"""
