"""Operators of the llm subpackage against brute force, round trips and defined edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from registrum.llm import decontaminate, induced, licenses, packing, personal_data, quality_model, quality_rules, repeats, secrets, simhash, tokens
from registrum.llm.common import words as ascii_words
from tests.llm.cases import frame, got, odd_texts

ROWS = odd_texts()
BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ROWS[:1]).limit(0)


# --- quality rules
def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, none):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert got(quality_rules.ledger(docs), *cols) == sorted(((i, *measures(t)) for i, t in ROWS), key=repr)
    assert quality_rules.ledger(none).count() == 0


def test_policies_and_ablations(spark):
    b = quality_rules.BIT
    led = spark.createDataFrame([(1, 0), (2, b["few_words"]), (3, b["few_words"] | b["symbols"]), (4, b["shouting"])], "doc_id long, fail_bits long")
    assert got(quality_rules.apply_policy(led, quality_rules.BASE), "doc_id", "kept", "policy") == [(1, True, "base"), (2, False, "base"), (3, False, "base"), (4, True, "base")]
    p = quality_rules.Policy("t", ("few_words", "symbols"))
    assert got(quality_rules.ablations(led, p), "rule", "n_failed", "n_only", "n_kept_without") == [("few_words", 2, 1, 3), ("symbols", 1, 0, 2)]


# --- SimHash
def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    n = [0] * 64
    for x in g:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(g))


def brute_components(fps, most=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= most and find(a) != find(b):
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, none):
    by_row = [(i, brute_fingerprint(t)) for i, t in ROWS]
    root = brute_components({f for _, f in by_row})
    ids = collections.defaultdict(list)
    for i, f in by_row:
        ids[root[f]] += [i] * (i is not None)
    expect = sorted(((i, f - (1 << 64) if f >> 63 else f, min(ids[root[f]], default=None)) for i, f in by_row), key=repr)
    assert got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == expect
    assert simhash.near_duplicates(none).count() == 0 and dict(by_row)[101] == 0


def test_simhash_links_texts_not_ids(spark):
    """Unlike texts under one id, or none, are linked for themselves; a component without any id has none."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a, b, c = (" ".join(word() for _ in range(400)) for _ in range(3))
    near = lambda t: next(x for k in range(400) if (x := " ".join([*t.split()[:k], "edit", *t.split()[k + 1 :]])) and 0 < (brute_fingerprint(x) ^ brute_fingerprint(t)).bit_count() <= 3)
    rows = [(7, a), (7, b), (9, near(b)), (3, near(a)), (None, near(a)), (None, c), (None, near(c))]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in out), key=repr) == sorted([(7, 3), (7, 7), (9, 7), (3, 3), (None, 3), (None, None), (None, None)], key=repr)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_lose_no_component(spark, monkeypatch, block):
    """Clusters around a few centres, chains included; small blocks deal hot buckets out in pairs."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(25):
            g = f
            for _ in range(rng.randrange(5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
            f = g if rng.random() < 0.3 else f
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", block)
    d = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(d)).collect()}
    root = brute_components(set(fps))
    least = {}
    for k, f in enumerate(fps):
        least.setdefault(root[f], k)
    assert [comp.get(k, k) for k in range(len(fps))] == [least[root[f]] for f in fps]


def test_simhash_sends_no_table_through_the_driver(docs, monkeypatch):
    """Written tables look small to the planner, which would broadcast them; no join may, whatever their size."""
    plans, write = [], simhash.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "staged", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    plans.append(plan(simhash.near_duplicates(docs)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_links_of_runs_that_batches_cut(size):
    """Short and long runs, of one block and of two, give forests of the links inside each run and of no others."""
    rng = random.Random(8)
    rows, want = [], collections.defaultdict(list)
    for key in range(120):
        n, base, two = rng.choice([1, 2, 2, 3, 9, 16, 17, 40]), rng.getrandbits(64), rng.random() < 0.4
        own = [(key, 0, int(two), rng.choice([1, 2]) if two else 0, 1000 * key + k, base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))) for k in range(n)]
        rows += own
        want[key] = [(a[4], b[4]) for i, a in enumerate(own) for b in own[i + 1 :] if (a[5] ^ b[5]).bit_count() <= 3 and (not two or a[3] != b[3])]
    kinds = ("int64", "int32", "int32", "int32", "int64", "uint64")
    cols = [np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)]
    cols[5] = cols[5].view(np.int64)
    batches = [pa.record_batch([pa.array(c[k : k + size]) for c in cols], names=list(simhash.SORTED)) for k in range(0, len(rows), size)]
    found = [(x["a"], x["b"]) for b in simhash._links(iter(batches)) for x in b.to_pylist()]

    def parts(pairs):
        root = {r[4]: r[4] for r in rows}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        return root

    assert all(a < b for a, b in found) and set(found) <= {p for v in want.values() for p in v}
    roots = parts(found)
    assert roots == parts(p for v in want.values() for p in v) and len(found) == len(rows) - len(set(roots.values()))


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 5), (5, 3)], "a long, b long")
    c = dict(got(simhash.components(e), "node", "component"))
    assert c == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3}


# --- tokens and packing
STRANGE = ["", " ", "a  b\t c\n\n d", "x<|endoftext|>y <|endoftext|>", "don't 'S we'll", "日本語　x", "a\xa0b\x85c\x1cd", "ÉCOLE ß İ ΣΑΣ ½ 12345", "é ́x", "<|startoftext|>ab<|endof"]


def strange(n):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "a", "B", "é", "1", "!", "'s", "<|endoftext|>", "<|", "|>", "\t", "日", "\xa0"]
    return STRANGE + ["".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_pieces_equal_the_library():
    for path, lower in ((BYTE, False), (WORD, True)):
        c = tokens.PieceEncoder(path, lower=lower, cache=50)
        assert all(c.encode(t) == c.direct(t) for t in strange(800) + [t or "" for _, t in ROWS])
        assert all(c.count(t) == len(c.direct(t)) // 4 for t in strange(800) + [t or "" for _, t in ROWS])


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 4), (17, 16), (1000, 64)])
def test_splices_equal_the_library(chunk, overlap):
    c = tokens.PieceEncoder(BYTE)
    for t in strange(300) + ["ab" * 700, "<|endoftext|>" * 40, " " * 500 + "x"]:
        assert c.encode_long(t, chunk, overlap) == c.t.encode(t, add_special_tokens=False).ids


def test_token_counts(docs, none):
    t = tokens.load(BYTE)
    expect = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in ROWS]
    assert got(tokens.token_counts(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expect, key=repr)
    assert tokens.token_counts(none, BYTE).count() == 0


def test_packing_round_trip(docs, none):
    t = tokens.load(WORD)
    rows = packing.pack_documents(docs, WORD, 512).collect()
    pieces = []
    for i, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, k // 512, k, len(p := ids[k : k + 512]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), 512)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(pieces, key=repr)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = 0
        for o, n in sorted(b):
            assert o == ends
            ends += n
        assert ends <= 512
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 512) + 1
    assert packing.pack_documents(none, WORD).count() == 0


def optimum(sizes, cap):
    """Fewest bins, by trying every place of every item."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - sizes[k]])
        go(k + 1, [*bins, cap - sizes[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    """What the reduction fixed and the best of what it left make no more bins than the optimum."""
    rng = random.Random(8)
    for _ in range(150):
        cap = rng.choice([10, 17, 30])
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))]
        plan = packing.Plan.__new__(packing.Plan)
        plan.cap, plan.left, plan.used, plan.bins, plan.placed = cap, dict(collections.Counter(sizes)), {}, 0, []
        plan.reduce()
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert plan.bins + (optimum(rest, cap) if rest else 0) == optimum(sizes, cap), (cap, sizes)


# --- licences
def test_licenses(docs, none, spark):
    rows = licenses.license_matches(docs).collect()
    expect = []
    for i, t in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        expect.append((i, len(w), sorted((k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())))
    assert sorted(((r["doc_id"], r["n_words"], sorted((m["start"], m["label"]) for m in r["matches"] if m["base"])) for r in rows), key=repr) == sorted(expect, key=repr)
    assert licenses.license_matches(none).count() == 0


def edited(text, phrases, rng, least=0.85):
    """A notice with words outside its mandatory phrases changed, left out or added."""
    w, fixed = text.split(), set()
    for p in phrases:
        i = next(i for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        fixed.update(range(i, i + len(p.split())))
    out = []
    for i, x in enumerate(w):
        if i in fixed or rng.random() < least:
            out.append(x)
        else:
            out += rng.choice([["edited"], [], [x, "more"]])
    return " ".join(out)


def test_license_notices(spark):
    """Whole and edited notices are labelled, amid other words; one without a mandatory phrase only has a score."""
    rng = random.Random(6)
    rows, expect = [], {}
    for label, text, phrases in licenses.TEMPLATES:
        for k, body in enumerate([text, edited(text, phrases, rng), edited(text, phrases, rng), text.replace(phrases[1], "something else")]):
            expect[len(rows)] = label if k < 3 else None
            rows.append((len(rows), "// Some file 1.0\n" + " * ".join(body.upper().split(" ", 3)) + "\nint main() { return 0; }"))
    rows += [(900, "GNU Lesser General Public License"), (901, "Licensed under the Apache License, Version 2.0."), (902, "nothing of the kind"), (None, licenses.TEMPLATES[0][1])]
    out = {r["doc_id"]: r["matches"] for r in licenses.license_matches(frame(spark, rows)).collect()}
    whole = lambda i: {m["label"] for m in out[i] if m["whole"] and not m["base"]}
    kinds = {x[0]: {x[0]} for x in licenses.TEMPLATES} | {"bsd-3": {"bsd-3", "bsd-2"}}  # the longer one holds the other's phrases
    for i, label in expect.items():
        if label:
            assert label in whole(i) and whole(i) <= kinds[label] | {n for n, _ in licenses.NAMES}, (i, label, whole(i))
        else:
            assert not whole(i) & {x[0] for x in licenses.TEMPLATES} - {n for n, _ in licenses.NAMES}, i
    partial = [max(m["share"] for m in out[i] if not m["whole"]) for i, label in expect.items() if not label and any(not m["whole"] for m in out[i])]
    assert len(partial) == len(licenses.TEMPLATES) and all(0 < x < 1 for x in partial)
    assert whole(900) == {"lgpl"} and whole(901) == {"apache-2.0"} and not out[902] and "mit" in whole(None)


def test_license_edits_beside_exact_notices(spark):
    """Any word outside the mandatory phrases may be edited, though exact copies make it the rarest of its template."""
    _, text, phrases = licenses.TEMPLATES[0]
    whole = text.split()
    held = set()
    for p in phrases:
        i = next(i for i in range(len(whole)) if whole[i : i + len(p.split())] == p.split())
        held.update(range(i, i + len(p.split())))
    free = [k for k in range(len(whole)) if k not in held]
    rows = [(1000 + k, " ".join(whole)) for k in range(5)] + [(k, " ".join([*whole[:k], "edited", *whole[k + 1 :]])) for k in free]
    out = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all([m["label"] for m in r["matches"] if m["whole"]] == ["mit"] for r in out) and len(out) == len(rows)


# --- secrets
def base_secrets(t):
    """The base kinds straight from their definition."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def secret_texts():
    rng = random.Random(21)
    bits = ["password", "PassWd", "sEcret", "token", "api_key", "APIKEY", "apikey", '"', "'", " ", "  ", ":", "=", "==", "abcdef", "x9+/_.=-", "short", "é", "ſecret", "AKIA", "AKIA" + "A1" * 8, "AKIA" + "Z" * 15, "0a" * 12, "f" * 23, "F" * 24, "\n", "😀", "ghp_" + "x" * 36]
    return [(2000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(700)]


def spans_of(df):
    return sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in df.collect()), key=repr)


def test_secrets_against_their_definition(spark):
    rows = ROWS + secret_texts()
    d = frame(spark, rows)
    out = spans_of(secrets.findings(d, secrets.Ledger(spark).update(d)))
    assert [(i, [x for x in s if x[0] in secrets.BASE]) for i, s in out] == sorted(((i, base_secrets(t or "")) for i, t in rows), key=repr)
    assert sum(len(s) for _, s in out) > 200


def test_the_ledger_is_incremental(spark, none, tmp_path):
    """A later run scans new blobs, and old ones only under new versions; every path gets its findings."""
    book = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    old, new = frame(spark, ROWS), frame(spark, ROWS + [(900, "token=abcdef99 and " + "0a" * 12), (901, ROWS[3][1])])
    assert book.update(old).count() == len({t or "" for _, t in ROWS})
    assert secrets.scan(old, book.rows()).count() == 0  # nothing unseen
    assert [r["rules"] for r in secrets.scan(new, book.rows()).collect()] == [[r.name for r in secrets.RULES]]  # the one new blob
    rows = book.update(new)
    newer = tuple(secrets.Rule(r.kind, 2, "[0-9a-f]{26,}", r.hints, r.group, r.least) if r.kind == "hex" else r for r in secrets.RULES)
    again = secrets.scan(new, rows, newer)
    assert {tuple(r["rules"]) for r in again.collect()} == {("hex@2",)} and again.count() == rows.count()
    rows = book.update(new, newer)
    one = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.findings(new, rows).collect()}
    two = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.findings(new, rows, newer).collect()}
    assert one[900] == ["assign", "hex"] and two[900] == ["assign"]  # each version has its own findings
    twice = rows.unionByName(rows)  # a repeated append
    assert spans_of(secrets.findings(new, twice)) == spans_of(secrets.findings(new, rows)) and secrets.scan(new, twice).count() == 0
    assert secrets.scan(none, rows).count() == 0
    spark.conf.set(secrets.LEDGER, book.path)
    try:
        assert secrets.Ledger(spark).rows().count() == rows.count()
    finally:
        spark.conf.unset(secrets.LEDGER)


def test_secret_kinds_and_redaction(spark):
    t = "Password: 'hunter22' AKIA" + "A" * 16 + " " + "0a" * 12 + " ſecret=abcdefg ghp_" + "x" * 36 + " secret=short"
    assert [k for k, _, _ in secrets.find(t, secrets.RULES)] == ["assign", "access", "hex", "forge"]
    d = frame(spark, [(1, t), (2, None), (3, "clean")])  # with columns named blob and spans
    out = secrets.redact(d, secrets.findings(d, secrets.Ledger(spark).update(d)))
    texts = dict(got(out, "doc_id", "text"))
    assert out.columns == d.columns and {r["blob"] for r in out.collect()} == {"?"}
    assert "hunter22" not in texts[1] and texts[1].count("[SECRET]") == 4 and texts[2] is None and texts[3] == "clean"


def test_secrets_of_rows_without_an_id(spark):
    rows = [(None, "password=hunter2222"), (None, "token=abcdef12345"), (None, "clean"), (None, None), (1, "secret=abcdefgh"), (None, "secret=abcdefgh"), (None, "token=abcdef12345")]
    d = frame(spark, rows)
    ledger = secrets.Ledger(spark).update(d)
    assert ledger.count() == 5
    found = secrets.findings(d, ledger)
    assert spans_of(found) == sorted(((i, base_secrets(t or "")) for i, t in rows), key=repr)
    assert got(secrets.redact(d, found), "doc_id", "text") == sorted([(i, "[SECRET]" if "=" in (t or "") else t) for i, t in rows], key=repr)


# --- personal data
def pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    spans = lambda p, ok=lambda m: True: [(m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return [
        spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        spans(r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]


def test_personal_data(spark, none):
    rng = random.Random(4)
    bits = ["1", "4", "0", "9", "255", ".", ".", "-", " ", "@", "a", "b.c", "_", "%", "+", "(", ")", "é", "😀", "4111111111111111", "x@y.z", "1.2.3.4", "+1 (555) 123-4567", "\n"]
    rows = ROWS + [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(600)] + [(5000, "a" * 20_000 + "@b.c"), (5001, "1" * 9000), (5002, "1 " * 2000)]
    out = got(personal_data.personal_data(frame(spark, rows)), "doc_id", *personal_data.BASE)
    assert [(r[0], *[[tuple(s) for s in x] for x in r[1:]]) for r in out] == [(r[0], *r[1:]) for r in sorted(((i, *pii(t or "")) for i, t in rows), key=lambda r: repr((r[0], *[[personal_row(s) for s in x] for x in r[1:]])))]
    assert personal_data.personal_data(none).count() == 0


def personal_row(s):
    from pyspark.sql import Row

    return Row(start=s[0], end=s[1])


def test_bootstrap_discovers_and_stays_silent(spark):
    """A context that introduces emails introduces an odd address too; contexts of all sorts add nothing."""
    rows = [(i, f"please write to user{i}@mail.example.org today") for i in range(20)] + [(50, "please write to joe4321(at)mail now"), (51, "the number 123456 and the 9999999 of the 8888888")]
    out = {r["doc_id"]: r["context"] for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in out[50]] == [(16, 31)] and not any(v for k, v in out.items() if k != 50)


def test_bootstrap_finds_forms_of_seeds(spark):
    """Numbers of the form of known cards are found though their check digit is wrong; other numbers are not. One text is a third of the rows."""
    rng = random.Random(12)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, wrong = [], {}
    for i in range(400):
        d = "".join(rng.choice("0123456789") for _ in range(16))
        a, b = f"{word()} {word()} ", f" {word()}"
        rows.append((i, a + d + b))
        if not luhn(d):
            wrong[i] = (len(a), len(a) + 16)
    rows += [(1000 + i, f"{word()} {rng.randrange(10**6, 10**7)} {word()}") for i in range(50)] + [(2000 + i, rows[0][1]) for i in range(200)] + [(None, rows[0][1])]
    out = personal_data.personal_data(frame(spark, rows)).select("doc_id", "context").collect()
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["context"]] for r in out if r["context"]}
    held = {r[0]: rows[0][1] for r in rows if r[1] == rows[0][1]}
    expect = {i: [x] for i, x in wrong.items()} | ({i: [wrong[0]] for i in held} if 0 in wrong else {})
    assert found == expect and len(wrong) > 300


# --- decontamination
def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    item = [f"w{rng.randrange(500)}" for _ in range(40)]
    edited = [w if k % 11 else "edit" for k, w in enumerate(item)]
    filler = [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(filler + item + filler)), (2, " ".join(filler[:9] + edited)), (3, " ".join(filler)), (4, " ".join(item[:8] + filler)), (5, None), (1, " ".join(item)), (6, " ".join(item[:20] + filler[:3] + item[20:]))]
    bench = spark.createDataFrame([(7, " ".join(item), "?"), (8, None, "?"), (9, "", "?"), (7, " ".join(item), "?"), (10, "two words", "?")], "item_id long, text string, score string")
    out = got(decontaminate.contaminated(frame(spark, rows), bench), "doc_id", "item_id", "n_equal", "start_word")
    assert [r[:2] for r in out] == [(1, 7), (1, 7), (2, 7), (6, 7)] and (1, 7, 40, 60) in out
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_every_alignment_that_counts(spark):
    """Copies edited at every 4th to 8th word, by another word or one more, beside an exact copy."""
    rng = random.Random(4)
    items = {i: [f"w{rng.randrange(300)}" for _ in range(rng.randrange(15, 60))] for i in range(25)}
    rows, at = [(1000 + i, " ".join(w)) for i, w in items.items()], {}
    for i, w in items.items():
        for step in range(4, 9):
            for more in (False, True):
                edited = [x for q, word in enumerate(w) for x in ([f"e{q}", word][: 1 + more] if q % step == step - 1 else [word])]
                at[len(at)] = i, edited
                rows.append((len(at) - 1, " ".join(["v"] * 9 + edited + ["v"] * 9)))
    code = {x: k for k, x in enumerate(sorted({x for w in items.values() for x in w}), 1)}
    ids = lambda w: np.array([code.get(x, 0) for x in w])
    expect = [(1000 + i, i) for i in items]
    for d, (i, edited) in at.items():
        s, equal, _, _ = decontaminate.align(ids(items[i]), ids(edited))
        expect += [(d, i)] * (s >= decontaminate.SCORE * 2 * len(items[i]) and equal >= decontaminate.EQUAL)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert got(decontaminate.contaminated(frame(spark, rows), bench), "doc_id", "item_id") == sorted(expect, key=repr)
    assert len(expect) > 250


@pytest.mark.parametrize("most", [1, 100_000])
def test_decontamination_searches_items_without_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
    items = [" ".join(f"{k}{j}" for j in range(20)) for k in "abcd"]
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (1, items[2]), (2, items[3]), (2, items[0]), (None, None)], "item_id long, text string")
    rows = [(10, items[0]), (11, items[1] + " x " + items[0]), (12, items[2]), (None, items[3]), (14, "clean")]
    out = got(decontaminate.contaminated(frame(spark, rows), bench), "doc_id", "item_id")
    assert out == sorted([(10, None), (10, 2), (11, None), (11, None), (11, 2), (12, 1), (None, 2)], key=repr)


def test_smith_waterman():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] and b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        s, equal, start, end = decontaminate.align(a, b)
        assert s == plain(a, b) and 0 <= start <= end <= len(b) and equal <= end - start


# --- classifier
def test_classifier_learns_and_scores_everything(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    unit, bias = quality_model.fit(docs, labels)
    assert np.array_equal(unit, quality_model.fit(docs, labels)[0])  # the same model again
    s = {r["doc_id"]: r["score"] for r in quality_model.scored(docs, unit, bias).collect()}
    held = [(s[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(s) == docs.count() and sum((p >= 0.3) == bool(y) for p, y in held) / len(held) > 0.9
    odd = quality_model.scored(frame(spark, ROWS), unit, bias).collect()
    direct = [1 / (1 + np.exp(-(float(v.astype(np.float64) @ unit[k]) + bias))) for k, v in (quality_model.features(t or "") for _, t in ROWS)]
    assert np.allclose(sorted(r["score"] for r in odd), sorted(direct), atol=1e-5)
    flat = quality_model.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.scored(frame(spark, ROWS[:3]), *flat).collect()} == {0.5}


# --- repeats
def brute_repeats(texts, length=400):
    """n_bytes, n_removed, n_spans, kept_sha256 straight from the definition."""
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def naive_order(b, depth):
    sa = sorted(range(len(b)), key=lambda i: b[i : i + depth])
    common = lambda x, y: next((k for k in range(depth) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b) or y + k >= len(b)), depth)
    return sa, [0, *map(common, sa, sa[1:])]


def test_induced_sorting(monkeypatch):
    rng = random.Random(3)
    for _ in range(120):
        n, letters = rng.randrange(1, 60), rng.choice([1, 2, 3, 250])
        b = bytes(rng.randrange(letters) for _ in range(n))
        b = b + b[: rng.randrange(1, n + 1)] + b if rng.random() < 0.4 else b
        depth = rng.choice([3, 8, 1000])
        monkeypatch.setattr(induced, "BATCH", rng.choice([1, 7, 1 << 17]))
        monkeypatch.setattr(induced, "RUN", rng.choice([1, 3, 16, 1 << 19]))
        sa, lcp = induced.suffix_array(np.frombuffer(b, np.uint8), depth, rng.choice([10, 1 << 20]), induced.Scratch(rng.choice([0, 1 << 20])))
        expect, common = naive_order(b, depth)
        assert [b[i : i + depth] for i in sa] == [b[i : i + depth] for i in expect] and list(lcp) == common


@pytest.mark.parametrize("cap", [1500, 5])
def test_repeats(spark, none, cap):
    rng = random.Random(5)
    base, rows = "".join(rng.choice("abcdéfgh ") for _ in range(900)), list(ROWS)
    for i in range(60):
        b = list(base)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice("XYZ")
        rows.append((1000 + i, "".join(rng.choice("abc ") for _ in range(rng.randrange(200))) + "".join(b[rng.randrange(200) :]) + "q" * rng.choice([0, 0, 500])))
    d = frame(spark, rows)
    out = got(repeats.strip(d, repeats.repeated(d, cap=cap)), "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert out == sorted(((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]))), key=repr)
    assert repeats.strip(none, repeats.repeated(none)).count() == 0


@pytest.mark.parametrize("cap", [1500, 1])
def test_repeats_of_rows_without_an_id(spark, cap):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(900), text(900)
    rows = [(None, text(50) + a), (None, text(80) + a[:600] + text(90)), (7, text(20) + a[100:]), (None, b), (None, b), (8, text(99) + b[300:]), (None, text(700)), (None, None)]
    d = frame(spark, rows)
    out = got(repeats.strip(d, repeats.repeated(d, cap=cap)), "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert out == sorted(((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]))), key=repr)


# --- pipeline
def test_pipeline(spark):
    """Stages over odd documents: each keeps the columns of documents, decisions take effect, clean documents stay."""
    from registrum.llm import pipeline
    from registrum.llm.common import staged

    rng = random.Random(2)
    clean = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(90)}" for _ in range(80))
    item = open_item(spark)
    texts = [clean() for _ in range(30)]
    rows = list(enumerate(texts)) + [(100, texts[0]), (101, texts[1] + " x"), (102, clean() + " " + item), (103, clean() + " password=hunter2222"), (104, "too short"), (105, "SHOUT!! " * 80), (106, None), (5, texts[5])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    seen = {}
    for name, stage in pipeline.STAGES:
        d = staged(stage(spark, d, sf), name)
        seen[name] = d
        if name != "best_fit_packing":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].select("doc_id").collect())
    kept = [*range(30), 102, 103]
    assert set(ids("quality")) == {*range(30), 100, 101, 102, 103}
    assert ids("near_dedup") == kept
    assert ids("decontamination") == [*range(30), 103]
    texts_out = {r["doc_id"]: r for r in seen["secret_scan"].collect()}
    assert texts_out[103]["text"].endswith("[SECRET]") and texts_out[103]["n_chars"] == len(texts_out[103]["text"]) and texts_out[7]["text"] == texts[7]
    assert ids("best_fit_packing") == [*range(30), 103]


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the operators' own pass through every stage, with their values."""
    from registrum.llm import pipeline

    rng = random.Random(8)
    clean = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(90)}" for _ in range(80))
    d = frame(spark, [(i, clean() + " token=abcdef99") for i in range(6)] + [(None, clean()), (7, "short"), (8, None), (None, "")])
    for name, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, "/root/testdata/sf0.001").cache()
        r = d.collect()
        assert len(r) == 7 and d.columns == frame(spark, ROWS[:1]).columns and {x["blob"] for x in r} == {x["spans"] for x in r} == {"?"}, name
    assert sum("[SECRET]" in x["text"] for x in r) == 6 and all(x["n_chars"] == len(x["text"]) for x in r)
    last = pipeline.STAGES[-1][1](spark, d, "/root/testdata/sf0.001")
    assert last.count() == 7
    empty = d.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_pipeline_decides_for_rows(spark):
    """Rows without a doc_id, and two texts under one, are kept or dropped for their own text."""
    from registrum.llm import pipeline

    rng = random.Random(3)
    clean = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(90)}" for _ in range(80))
    a, b, c, e, f = (clean() for _ in range(5))
    leak, bad = clean() + " " + open_item(spark), "too short"
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, e), (None, bad), (3, bad), (3, f), (None, leak), (1, leak), (None, e)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    names = {a: "a", b: "b", c: "c", e: "e", f: "f", leak: "leak", bad: "bad"}
    for (name, stage), expect in zip(
        pipeline.STAGES[:3],
        [
            [(None, "a"), (None, "b"), (None, "b"), (1, "c"), (2, "c"), (2, "e"), (3, "f"), (None, "leak"), (1, "leak"), (None, "e")],
            [(None, "a"), (None, "b"), (1, "c"), (2, "e"), (3, "f"), (1, "leak")],
            [(None, "a"), (None, "b"), (1, "c"), (2, "e"), (3, "f")],
        ],
    ):
        d = stage(spark, d, "/root/testdata/sf0.001")
        assert sorted(((r["doc_id"], names[r["text"]]) for r in d.collect()), key=repr) == sorted(expect, key=repr), name
    hidden = spark.createDataFrame([(None, leak), (None, a)], "doc_id long, text string")
    assert [r["text"] for r in pipeline.decontamination(spark, hidden, "/root/testdata/sf0.001").collect()] == [a]


def open_item(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 150").orderBy("item_id").first()["text"]


def test_words():
    assert ascii_words("It's A-1 É x") == [b"it", b"s", b"a", b"1", "É x".encode()]
