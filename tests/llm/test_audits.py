"""Fingerprints, manifests and filter audits against brute force, on odd rows and whole tables."""

import collections
import hashlib
import itertools
import re
import unicodedata
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from registrum.llm import fingerprints, interactions, merkle
from registrum.llm.queries import QUERIES
from tests.llm.cases import frame, got, odd_texts

DIR = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def signed(t):
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def brute_edits(rows):
    """doc_id, n_chars, edited_sha256, and whether the canonical text is that of the edited text and of the next document."""
    d = sorted(((i is not None, i or 0, signed(t or ""), t or "", i) for i, t in rows))
    for k, (*_, t, i) in enumerate(d):
        n, following = len(t) // 2, d[(k + 1) % len(d)][3]
        changed = t[: len(t) - n] + following[:n]
        yield i, len(t), hashlib.sha256(changed.encode()).hexdigest(), float(canon(t) == canon(changed)), float(canon(t) == canon(following))


ODD = [*odd_texts(), (130, "Straße ﬁn  Å"), (131, "STRASSE fin Å "), (132, "x y"), (133, "X Y"), (134, "x y!")]
EDITED = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")


@pytest.mark.parametrize("blocks", [1, 7])
def test_edited_fingerprints_of_odd_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 1 if blocks > 1 else 1 << 40)
    monkeypatch.setattr(fingerprints, "BLOCKS", blocks)
    out = fingerprints.edited(frame(spark, ODD))
    assert got(out, *EDITED) == sorted(brute_edits(ODD), key=repr)
    prints = collections.defaultdict(set)
    by_id = {i: t for i, t in ODD if i is not None and i != 4 and i != 5}
    for i, f in got(out.filter("doc_id not in (4, 5)"), "doc_id", "fingerprint"):
        prints[canon(by_id[i] or "")].add(f)
    assert all(len(f) == 1 for f in prints.values()) and len({min(f) for f in prints.values()}) == len(prints)


def test_unlike_texts_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide", lambda t: [F.length(t).cast("long") % 3, F.lit(0).cast("long")])
    out = {i: f for i, f in got(fingerprints.fingerprints(frame(spark, [r for r in ODD if r[0] not in (None, 4, 5)])), "doc_id", "fingerprint")}
    texts = {i: canon(t or "") for i, t in ODD if i in out}
    assert all((texts[a] == texts[b]) == (out[a] == out[b]) for a, b in itertools.combinations(out, 2))
    sizes = collections.Counter(f for _, f in got(fingerprints.fingerprints(frame(spark, ODD)), "doc_id", "fingerprint"))
    assert {f: n for f, n in got(fingerprints.groups(fingerprints.fingerprints(frame(spark, ODD))), "fingerprint", "n")} == sizes


def test_all_buckets_are_compared_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "FEW", 0)
    monkeypatch.setattr(fingerprints, "wide", lambda t: [F.length(t).cast("long"), F.lit(0).cast("long")])
    out = {i: f for i, f in got(fingerprints.fingerprints(frame(spark, [(1, "ab"), (2, "AB "), (3, "cd"), (4, "ef"), (5, "abc")])), "doc_id", "fingerprint")}
    assert out[1] == out[2] and len({out[k] for k in (1, 3, 4, 5)}) == 4


def test_fingerprints_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_document_fingerprints"](spark, DIR), *EDITED) == sorted(brute_edits(rows), key=repr)


def test_fingerprints_stay_in_the_jvm(spark):
    plan = fingerprints.edited(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "reflect(com.ibm.icu" in plan and not re.search("Arrow|BatchEval|InPandas|PythonUDF", plan)


def brute_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def brute_path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        out.append(([n for k, n in enumerate(nodes[first : first + fanout], first) if k < at], [n for k, n in enumerate(nodes[first : first + fanout], first) if k > at]))
        at //= fanout
    return out


def brute_manifest(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = collections.defaultdict(list)
    for i, source, lang, n, text in rows:
        leaf = lambda c: H(*map(part, (i, source, lang, c, text)))  # noqa: B023, E731
        bad = leaf(n + 1) if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None
        langs[lang].append((i is not None, i or 0, leaf(n), bad, i))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: brute_tree([r[2] for r in sorted(v, key=lambda r: r[:3])], fanout) for k, v in langs.items()}
    top = brute_tree([trees[k][-1][0] for k in order], fanout)
    for t, k in enumerate(order):
        for at, (*_, leaf, bad, i) in enumerate(sorted(langs[k], key=lambda r: r[:3])):
            path = [*brute_path(trees[k], at, fanout), *brute_path(top, t, fanout)]
            end = bad or leaf
            for a, b in path:
                end = H(*a, end, *b)
            yield i, leaf, trees[k][-1][0], top[-1][0], H(*[x for a, b in path for x in (*a, *b)]), end, end == top[-1][0]


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("fanout", "block", "merge"), [(2, 65536, 64), (2, 5, 2), (3, 7, 2), (4, 3, 3)])
def test_manifests_of_odd_rows(spark, monkeypatch, fanout, block, merge):
    rows = [(i, None if k % 5 == 0 else "web", [None, "", "de", "fr", "é"][k % 7 % 5 if k % 3 else 2], None if k % 11 == 0 else len(t or ""), t) for k, (i, t) in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("?") for c in ("part", "tree", "digest", "level", "at")})
    assert got(merkle.proven(df.repartition(3), fanout, block, merge), *PROOF) == sorted(brute_manifest(rows, fanout), key=repr)


def test_manifests_of_few_rows(spark):
    df = spark.createDataFrame([(7, "s", "de", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.proven(df), *PROOF) == list(brute_manifest([(7, "s", "de", 3, "abc")], 2))
    assert merkle.proven(df.limit(0)).collect() == []


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_stacks_give_what_whole_trees_give(fanout):
    for n in (1, 2, 3, 9, 26, 50):
        nodes = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        levels = brute_tree([d.hex() for d in nodes], fanout)
        cut = [(0, k, d) for k, d in enumerate(nodes)]
        both = [p for a, b in ((0, n // 3), (n // 3, n)) for p in merkle.carry(cut[a:b], fanout, {})]
        made = {}
        assert merkle.close(merkle.carry(both, fanout, made), n, fanout, made).hex() == levels[-1][0]
        for k, d in enumerate(nodes):
            path = [bytes.fromhex(x) for a, b in brute_path(levels, k, fanout) for x in (*a, *b)]
            assert merkle.fold(d, k, n, path, fanout).hex() == levels[-1][0]


def brute_audit(rows, labels):
    """rows: doc_id, lang, text; labels: doc_id, quality, toxic."""
    first, quality, toxic = {}, collections.defaultdict(bool), collections.defaultdict(bool)
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        quality[i] |= q == 1
        toxic[i] |= x == 1
    parts = collections.defaultdict(list)
    for i, lang, t in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[lang or ""].append(({k for k, v in bad.items() if v}, i is not None and quality[i], i is not None and toxic[i]))
    for part, docs in parts.items():
        removals, out = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in docs)
                out.append([part, "".join(order), step, len(stay), len(gone), fails - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
                removals[f] += len(gone)
                left = stay
        yield from (tuple([*r, removals[r[1][r[2] - 1]]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark):
    texts = [*ODD, (140, "Up $ " * 120), (141, "Up $ " * 120), (141, "Up $ " * 120), (None, "Up $ " * 120), (142, " ".join(f"w{k}" for k in range(150)))]
    rows = [(i, [None, "", "de"][k % 3], t) for k, (i, t) in enumerate(texts)]
    labels = [(i, k % 2, k % 3 % 2) for k, (i, _) in enumerate(texts)] + [(None, 1, 1), (9999, 1, 1), (140, None, 1)]
    docs = frame(spark, texts).drop("lang", "source", "n_chars").limit(0)
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, lang string, text string"), allowMissingColumns=True).withColumns({c: F.lit("?") for c in ("part", "mask", "label", "digest", "cells")}).repartition(3)
    docs = docs.select("doc_id", "text", "lang", *[c for c in docs.columns if c not in ("doc_id", "text", "lang")])
    out = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got(out, *AUDIT) == sorted(brute_audit(rows, labels), key=repr)
    assert interactions.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
