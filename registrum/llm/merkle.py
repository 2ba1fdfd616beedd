"""Merkle manifest of a table: a hash tree over each language's rows in order of doc_id, one over the trees' roots, and proofs.

Leaves are range-partitioned in order, so a partition is a block of consecutive leaves whose first index is known. A block is hashed
by a mountain-range stack: a node is pushed, and whenever the last `fanout` nodes of the stack are an aligned run they are carried
into their parent. What stays on the stack are the block's peaks, at most 2 * fanout a level; only they leave the block. Peaks of
MERGE neighbouring blocks meet on the next stack, where runs that a border cut are completed, until one stack holds a tree's
peaks; there the last, short run of each level is hashed as it is, without padding. Proofs come down the same way: a node's
siblings inside its block, then the path of the peak above it.

A block's size is bounded by BLOCK leaves (times the unevenness of range sampling), a merge by 2 * MERGE * fanout peaks a level.

Defined cases: a null column is hashed as "-"; a null doc_id comes first and is not tampered with; rows of one doc_id are ordered by
their leaf, so repeated rows may change places without a trace; texts of any length are hashed whole; extra columns are ignored; an
empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm.common import discard, documents, staged

FANOUT = 2
BLOCK = 65_536
MERGE = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, part int, level int, at long, digest binary"

Node = tuple[int, int, bytes]  # level, index within the level, digest


def leaf(**other: Column) -> Column:
    """The digest of a row's five columns, or of others in their place."""
    text = [F.coalesce(other.get(c, F.col(c)).cast("string"), F.lit(None)) for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language; "" for none), doc_id, digest and tampered: the leaf with one more character, where 7 divides the id's crc32."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    return docs.select(tree.alias("tree"), "doc_id", leaf().alias("digest"), F.when(hit, leaf(n_chars=F.col("n_chars") + 1)).alias("tampered"))


def digest(parts: Iterable[bytes]) -> bytes:
    """sha256 of digests joined as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def carry(nodes: Iterable[Node], fanout: int, made: dict[tuple[int, int], bytes]) -> list[Node]:
    """The peaks of consecutive nodes; made gets every node, given or new."""
    stack: list[Node] = []
    for level, at, d in nodes:
        made[level, at] = d
        stack.append((level, at, d))
        while len(stack) >= fanout and stack[-1][1] % fanout == fanout - 1 and stack[-fanout][0] == stack[-1][0]:
            run = stack[-fanout:]
            del stack[-fanout:]
            up = (run[0][0] + 1, run[0][1] // fanout, digest(r[2] for r in run))
            made[up[:2]] = up[2]
            stack.append(up)
    return stack


def close(peaks: list[Node], n: int, fanout: int, made: dict[tuple[int, int], bytes]) -> bytes:
    """The root of a whole tree of n leaves: the short run at the end of each level becomes a node of its own."""
    stack, level = list(peaks), 0
    while n > 1:
        k = len(stack)
        while k and stack[k - 1][0] == level:
            k -= 1
        if run := stack[k:]:
            del stack[k:]
            up = (level + 1, run[0][1] // fanout, digest(r[2] for r in run))
            made[up[:2]] = up[2]
            stack.append(up)
        n, level = -(-n // fanout), level + 1
    return stack[0][2]


def siblings(level: int, at: int, fanout: int, made: dict[tuple[int, int], bytes]) -> tuple[list[bytes], tuple[int, int]]:
    """The siblings of a node up to the highest node above it that made has, and that node."""
    out = []
    while (level + 1, at // fanout) in made:
        first = at // fanout * fanout
        out += [made[level, j] for j in range(first, first + fanout) if j != at and (level, j) in made]
        level, at = level + 1, at // fanout
    return out, (level, at)


def fold(d: bytes, at: int, n: int, path: list[bytes], fanout: int) -> bytes:
    """The root that a leaf at index at of n leads to, along its siblings."""
    k = 0
    while n > 1:
        first = at // fanout * fanout
        size = min(fanout, n - first)
        d = digest([*path[k : k + at - first], d, *path[k + at - first : k + size - 1]])
        k, at, n = k + size - 1, at // fanout, -(-n // fanout)
    return d


def _split(path: bytes) -> list[bytes]:
    return [path[i : i + 32] for i in range(0, len(path), 32)]


def _nodes(t: pa.Table, fanout: int) -> list[Node]:
    rows = zip(t["level"].to_pylist(), t["at"].to_pylist(), t["digest"].to_pylist())
    return sorted(rows, key=lambda r: r[1] * fanout ** r[0])


def indexed(nodes: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """A staged table of nodes (tree, digest and others) with part, the block, and pos, the place in it; order decides within a tree.

    Nodes that are equal in order and digest are kept apart by their place in the input, so no range grows with them.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(1, -(-n // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    key = ["tree", *order, "digest", "_tie"]
    out = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("_tie")
    return staged(out.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "merkle-blocks")


def placed(blocks: DataFrame) -> DataFrame:
    """blocks of indexed() with level 0, at (the index within the tree) and n (the tree's leaves)."""
    runs = blocks.groupBy("tree", "part").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("tree")
    before = F.sum("_n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return blocks.join(runs, ["tree", "part"]).withColumns({"at": F.col("pos") + F.col("_shift"), "level": F.lit(0)}).drop("pos", "_shift")


def peaks(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The peaks of every block: NODE. nodes: NODE, a block being a tree's rows with one part."""

    def climb(t: pa.Table) -> pa.Table:
        top = carry(_nodes(t, fanout), fanout, {})
        level, at, d = zip(*top)
        return pa.table({"tree": [t["tree"][0].as_py()] * len(top), "part": pa.array([t["part"][0].as_py()] * len(top), pa.int32()), "level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64()), "digest": pa.array(d, pa.binary())})

    return nodes.select("tree", "part", "level", "at", "digest").groupBy("tree", "part").applyInArrow(climb, NODE)


def tops(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row for each node of trees that meet in one group each: NODE, n, root and path (its siblings up to the root, joined)."""

    def top(t: pa.Table) -> pa.Table:
        made: dict[tuple[int, int], bytes] = {}
        root = close(carry(_nodes(t, fanout), fanout, made), t["n"][0].as_py(), fanout, made)
        path = [b"".join(siblings(k, a, fanout, made)[0]) for k, a in zip(t["level"].to_pylist(), t["at"].to_pylist())]
        return t.append_column("root", pa.array([root] * t.num_rows, pa.binary())).append_column("path", pa.array(path, pa.binary()))

    return nodes.groupBy("tree").applyInArrow(top, f"{NODE}, n long, root binary, path binary")


def lowered(nodes: DataFrame, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The paths of nodes whose block's peaks are in above (tree, part, level, at, path, n, root): NODE, n, root and path."""

    def down(t: pa.Table, up: pa.Table) -> pa.Table:
        made: dict[tuple[int, int], bytes] = {}
        carry(_nodes(t, fanout), fanout, made)
        paths = dict(zip(zip(up["level"].to_pylist(), up["at"].to_pylist()), up["path"].to_pylist()))
        found = (siblings(k, a, fanout, made) for k, a in zip(t["level"].to_pylist(), t["at"].to_pylist()))
        path = [b"".join(own) + paths[peak] for own, peak in found]
        return t.append_column("n", pa.array([up["n"][0].as_py()] * t.num_rows, pa.int64())).append_column("root", pa.array([up["root"][0].as_py()] * t.num_rows, pa.binary())).append_column("path", pa.array(path, pa.binary()))

    key = ("tree", "part")
    return nodes.groupBy(*key).cogroup(above.groupBy(*key)).applyInArrow(down, f"{NODE}, n long, root binary, path binary")


def summits(blocks: DataFrame, fanout: int = FANOUT, merge: int = MERGE) -> tuple[DataFrame, list[DataFrame]]:
    """The paths of every block's peaks (tree, part, level, at, digest, n, root, path), and the tables to discard when it is written."""
    nodes = placed(blocks)
    held = [staged(peaks(nodes, fanout), "merkle-peaks")]
    width, parts = 1, blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    while parts > width * merge:
        width *= merge
        joined = held[-1].withColumn("part", F.floor(F.col("part") / merge).cast("int"))
        held.append(staged(peaks(joined, fanout), "merkle-peaks"))
    total = blocks.groupBy("tree").agg(F.count("*").alias("n"))
    out = tops(held[-1].join(total, "tree").select("tree", "part", "level", "at", "digest", "n"), fanout)
    for below in reversed(held[:-1]):
        own = below.withColumn("_part", F.col("part")).withColumn("part", F.floor(F.col("part") / merge).cast("int"))
        out = lowered(own.drop("_part"), out, fanout).join(own.select("tree", "level", "at", "_part"), ["tree", "level", "at"]).withColumn("part", F.col("_part")).select(out.columns)
    return out, held


def proven(docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK, merge: int = MERGE) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if any), verified."""
    flat = staged(leaves(docs), "merkle-leaves")
    blocks = indexed(flat, ["doc_id"], block)
    discard(flat)
    low, used = summits(blocks, fanout, merge)
    low = staged(low, "merkle-paths")
    discard(*used)
    trees = low.select(F.col("tree").alias("lang"), F.lit("").alias("tree"), F.col("root").alias("digest")).distinct()
    roots = indexed(trees, ["lang"], block)
    high, used = summits(roots, fanout, merge)
    high = staged(lowered(placed(roots).select("tree", "part", "level", "at", "digest"), high, fanout), "merkle-roots")
    discard(*used)
    lang = placed(roots).select("lang", F.col("at").alias("top_at")).join(high.select(F.col("at").alias("top_at"), F.col("n").alias("top_n"), F.col("root").alias("top"), F.col("path").alias("top_path")), "top_at")
    above = low.join(lang.withColumnRenamed("lang", "tree"), "tree")

    def prove(t: pa.Table, up: pa.Table) -> pa.Table:
        made: dict[tuple[int, int], bytes] = {}
        carry(_nodes(t, fanout), fanout, made)
        paths = {k: _split(p) for k, p in zip(zip(up["level"].to_pylist(), up["at"].to_pylist()), up["path"].to_pylist())}
        n, subroot, root, over, top_at, top_n = (up[c][0].as_py() for c in ("n", "root", "top", "top_path", "top_at", "top_n"))
        over, rows = _split(over), []
        for at, d, bad in zip(t["at"].to_pylist(), t["digest"].to_pylist(), t["tampered"].to_pylist()):
            own, peak = siblings(0, at, fanout, made)
            path = own + paths[peak]
            end = fold(fold(d if bad is None else bad, at, n, path, fanout), top_at, top_n, over, fanout)
            rows.append((digest([*path, *over]).hex(), end.hex(), end == root))
        proof, end, ok = zip(*rows)
        return pa.table({"doc_id": t["doc_id"], "leaf": [d.hex() for d in t["digest"].to_pylist()], "subroot": [subroot.hex()] * len(rows), "root": [root.hex()] * len(rows), "proof_sha256": proof, "folded_root": end, "verified": ok})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed(blocks).groupBy("tree", "part").cogroup(above.groupBy("tree", "part")).applyInArrow(prove, schema)


def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every row; each seventh row is tampered with, and its fold misses the root."""
    return proven(documents(spark, sf_dir))


OP12_SQL = r"""
with recursive d as (select row_number() over () rid, * from documents),
e as (select rid, doc_id, lang, [coalesce(strlen(v) || ':' || v, '-') for v in [doc_id::varchar, source, lang, n_chars::varchar, text]] f,
  coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') more from d),
b as (select rid, doc_id, lang, sha256(array_to_string(f, '')) leaf, sha256(f[1] || f[2] || f[3] || more || f[5]) other from e),
crc as (select n, list_reduce([n::ubigint, 0::ubigint, 1::ubigint, 2::ubigint, 3::ubigint, 4::ubigint, 5::ubigint, 6::ubigint, 7::ubigint], lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) v from range(256) t(n)),
tbl as (select list(v order by n) t from crc),
h as (select rid, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)), lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::bigint])) c from b, tbl),
l as (select b.*, case when xor(c, 4294967295::ubigint) % 7 = 0 then other else leaf end start, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 ix from b left join h using (rid)),
t as (select lang, 0 lev, list(leaf order by ix) x from l group by lang
  union all select lang, lev + 1, [sha256(x[2 * i + 1] || coalesce(x[2 * i + 2], '')) for i in range((len(x) + 1) // 2)] from t where len(x) > 1),
s as (select lang, x[1] subroot, row_number() over (order by lang nulls first) - 1 top_at from t where len(x) = 1),
u as (select 0 lev, list(subroot order by top_at) x from s union all select lev + 1, [sha256(x[2 * i + 1] || coalesce(x[2 * i + 2], '')) for i in range((len(x) + 1) // 2)] from u where len(x) > 1),
g as (select rid, 0 stage, lev, x[xor(ix >> lev, 1) + 1] sib, (ix >> lev) % 2 odd from l join t on t.lang is not distinct from l.lang where len(x) > 1
  union all select rid, 1, lev, x[xor(top_at >> lev, 1) + 1], (top_at >> lev) % 2 from l join s on s.lang is not distinct from l.lang, u where len(x) > 1),
p as (select rid, list(struct_pack(sib := coalesce(sib, ''), odd := odd) order by stage, lev) p from g group by rid),
z as (select l.*, coalesce(p, []) p from l left join p using (rid)),
w as (select rid, p, 0 k, start cur from z union all select rid, p, k + 1, sha256(case when p[k + 1].odd = 1 then p[k + 1].sib || cur else cur || p[k + 1].sib end) from w where k < len(p)),
r as (select rid, cur from w where k = len(p)), root as (select x[1] root from u where len(x) = 1)
select doc_id, leaf, subroot, root, sha256(array_to_string([q.sib for q in p], '')) proof_sha256, cur folded_root, cur = root verified
from z join s on s.lang is not distinct from z.lang join r using (rid), root"""
