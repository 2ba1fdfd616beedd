"""The registered queries over whole tables (the smallest ones) against brute force, where SQL can't express them."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from registrum.llm import decontaminate, licenses, tokens
from registrum.llm.common import words
from registrum.llm.queries import QUERIES
from tests.llm.test_operators import BYTE, WORD, brute_components, brute_fingerprint, pii

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, *cols):
    df = QUERIES[name](spark, DIR)
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_decontamination(spark, texts):
    """Every item is aligned with every document that shares enough of its words."""
    bench = [(r["item_id"], r["text"] or "") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    code = {w: k for k, w in enumerate(sorted({w for _, t in bench for w in words(t)}), 1)}
    ids = lambda t: np.array([code.get(w, 0) for w in words(t)], dtype=np.int64)
    expect = []
    for d, t in texts:
        w = ids(t)
        held = set(w.tolist())
        for i, x in bench:
            item = ids(x)
            if len(item) and sum(c in held for c in item.tolist()) >= decontaminate.SCORE * len(item):
                s, equal, _, _ = decontaminate.align(item, w)
                expect += [(d, i)] * (s >= 2 * decontaminate.SCORE * len(item) and equal >= min(decontaminate.EQUAL, len(item)))
    assert rows(spark, "op1_benchmark_decontamination", "doc_id", "item_id") == sorted(expect, key=repr) and expect


def test_packing(spark, texts):
    t, pieces = tokens.load(WORD), []
    for d, x in texts:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(d, k // 4096, k, len(p := ids[k : k + 4096]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), 4096)]
    out = rows(spark, "op2_best_fit_packing")
    assert [r[:5] for r in out] == sorted(pieces, key=repr)
    bins = collections.defaultdict(list)
    for *_, length, _, sequence, offset in out:
        bins[sequence].append((offset, length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:])) and sum(b[-1]) <= 4096
    assert len(bins) <= -(-sum(p[3] for p in pieces) // 4096) + 1


def test_near_duplicates(spark, texts):
    fps = [(d, brute_fingerprint(t)) for d, t in texts]
    root = brute_components({f for _, f in fps})
    least = collections.defaultdict(list)
    for d, f in fps:
        least[root[f]].append(d)
    assert rows(spark, "op3_simhash_near_dedup", "doc_id", "fingerprint", "component_id") == sorted([(d, f"{f:016x}", min(least[root[f]])) for d, f in fps], key=repr)


def test_licenses(spark, texts):
    expect = []
    for d, t in texts:
        w = [x.decode() for x in words(t)]
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        expect.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    out = rows(spark, "op4_license_scans")
    assert [r[:6] for r in out] == sorted(expect, key=repr)
    assert all(set(r[5].split(",")) - {""} <= set(r[6].split(",")) for r in out)
    index = licenses.Index(licenses.weights(spark.read.parquet(f"{DIR}/documents.parquet")))
    best = {d: max((share for *_, share, _ in index.match(words(t))), default=0.0) for d, t in texts}
    assert all(abs(r[7] - min(1, best[r[0]])) < 1e-9 for r in out)
    assert all((r[7] == 1) == bool(r[6]) for r in out) and any(r[7] == 0 for r in out)  # these texts hold whole names and no notices


def test_personal_data(spark, texts):
    expect = []
    for d, t in texts:
        found = list(zip(("email", "ip", "card", "phone"), pii(t)))
        spans = [f"{k}:{a}:{b}" for k, x in found for a, b in x]
        expect.append((d, *(len(x) for _, x in found), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    out = rows(spark, "op5_personal_data")
    assert [r[:6] for r in out] == sorted(expect, key=repr)
    assert all(hashlib.sha256(re.sub(r",?context:.*$", "", r[6]).encode()).hexdigest() == r[5] for r in out)


def test_token_counts(spark, texts):
    t = tokens.load(BYTE)
    n = {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in texts}
    assert rows(spark, "op7_token_counts") == sorted([(d, len(x.encode()), n[d], n[d] > 1024) for d, x in texts], key=repr)


def test_quality_scores(spark, texts):
    out = rows(spark, "op8_quality_classifier", "doc_id", "held_out", "score", "predicted")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert [(d, h) for d, h, _, _ in out] == sorted([(d, zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in texts], key=repr)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in out)
    held = [p == labels[d] for d, h, _, p in out if h and d in labels]
    assert sum(held) / len(held) > 0.8
