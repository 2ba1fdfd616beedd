"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The base kinds are found by regular expressions. Their matches seed the bootstrap: identifier-shaped tokens and their lexical
patterns (one or two words before a token; its shape, with runs of letters and of digits folded to a letter or a count) form a
graph of patterns and instances (the tokens). A pattern's confidence for a kind is the summed confidence of its instances of
that kind over all instances that count: for words all of them; for shapes those known to be of some kind, as an unknown one
has the very form of the seeds. Patterns over CONFIDENCE with SUPPORT seeds or more vote for the other tokens they fit, whose
confidence is the noisy-or of their patterns. Tokens over CONFIDENCE become instances of the kind and the next round scores
patterns with them. Only DataFrame functions are used; the
graph has distinct pattern-instance edges, so a token that a third of the rows repeat is one edge.

Matches are placed by splitting the text at them: lengths of the parts and matches before give code point offsets. Prefix sums
run in blocks, so texts with many matches stay near linear. Patterns take runs possessively from their start, which finds the
same leftmost matches without rescanning long runs.

Defined cases: null text counts as empty; repeated rows stay repeated; a row is judged by its text alone, so its doc_id may be
null or that of another text; of the words before a token the last BEFORE characters count; extra columns are ignored; an
empty table gives an empty result; spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm.common import discard, doc_texts, documents, staged

_LOCAL = r"A-Za-z0-9._%+-"
#: Kinds in order. Each finds the matches of the base pattern that can pass its check.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
#: Kind of what the bootstrap adds, after the base kinds.
CONTEXT = "context"
#: Identifier-shaped tokens: a digit or at sign in a run without white space.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 8, 2
#: Characters before a token that are kept for its patterns.
BEFORE = 80
_BLOCK = 64


def _prefix_sums(d: DataFrame, lengths: dict[str, str]) -> DataFrame:
    """For each name: array column, adds the sums before each element. Arrays are columns, so lambdas don't recompute them."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    index = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumns({f"{o}_b": _blocks(a, total, index) for o, a in lengths.items()})
    d = d.withColumns({f"{o}_c": _before(f"{o}_b", total, index) for o in lengths})
    return d.withColumns({o: _within(a, f"{o}_c", total, index) for o, a in lengths.items()}).drop(*[f"{o}_{x}" for o in lengths for x in "bc"])


def _blocks(a: str, total, index) -> Column:
    return F.transform(index(F.ceil(F.size(a) / _BLOCK).cast("int")), lambda b: total(F.slice(a, b * _BLOCK + 1, _BLOCK)))


def _before(a: str, total, index) -> Column:
    return F.transform(index(F.size(a)), lambda b: total(F.slice(a, F.lit(1), b)))


def _within(a: str, c: str, total, index) -> Column:
    return F.transform(index(F.size(a)), lambda i: F.get(c, F.floor(i / _BLOCK).cast("int")) + total(F.slice(a, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    n = F.length(_digits(m))
    digit = lambda i: F.substring(_digits(m), i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i))) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, blob, one array<struct<start, end>> for each base kind, and tokens (token, start, before) that look like identifiers."""
    d = doc_texts(docs).withColumn("blob", F.xxhash64("text"))
    some = F.col("text").rlike("[0-9@]")
    patterns = PATTERNS | {"token": _TOKEN}
    none = F.array().cast("array<string>")
    d = d.withColumns({f"{k}_m": F.when(some, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    d = d.withColumns({f"{k}_p": F.when(F.size(f"{k}_m") > 0, F.split("text", p, -1)).otherwise(none) for k, p in patterns.items()})
    d = d.drop("text")
    d = d.withColumns({f"{k}_l": F.zip_with(F.slice(f"{k}_p", F.lit(1), F.size(f"{k}_m")), f"{k}_m", lambda p, m: F.length(p) + F.length(m)) for k in patterns})
    d = _prefix_sums(d, {f"{k}_s": f"{k}_l" for k in patterns})

    def placed(k: str) -> Column:
        every = F.transform(f"{k}_m", lambda m, i: F.struct((F.get(f"{k}_s", i) + F.length(F.get(f"{k}_p", i))).alias("start"), (F.get(f"{k}_s", i) + F.get(f"{k}_l", i)).alias("end"), m.alias("m")))
        return F.transform(F.filter(every, lambda x: passes(k, x["m"])), lambda x: F.struct(x["start"], x["end"]))

    token = F.transform("token_m", lambda m, i: F.struct(m.alias("token"), (F.get("token_s", i) + F.length(F.get("token_p", i))).alias("start"), F.right(F.get("token_p", i), F.lit(BEFORE)).alias("before")))
    return d.select("doc_id", "blob", *[placed(k).alias(k) for k in BASE], token.alias("tokens"))


def edges(found: DataFrame) -> DataFrame:
    """blob, core (the token without outer punctuation), start, end, kind (of the base span it starts, else null), patterns."""
    one = found.dropDuplicates(["blob"])
    t = one.select("blob", F.explode("tokens").alias("t"))
    lead = F.length("t.token") - F.length(F.regexp_replace("t.token", r"^[(\[<{\"':;,.]+", ""))
    core = F.regexp_replace(F.regexp_replace("t.token", r"^[(\[<{\"':;,.]+", ""), r"[)\]>}\"':;,.!?]+$", "")
    t = t.select("blob", core.alias("core"), (F.col("t.start") + lead).alias("start"), F.col("t.before").alias("before"))
    t = t.filter("length(core) >= 5 and length(regexp_replace(core, '[^0-9]', '')) >= 4 or instr(core, '@') > 1")
    t = t.withColumns({"end": F.col("start") + F.length("core"), "rank": F.lit(-1)})
    spans = F.concat(*[_ranked(k, r) for r, k in enumerate(BASE)])
    s = one.select("blob", F.explode(spans).alias("s")).select("blob", "s.*")
    u = t.unionByName(s, allowMissingColumns=True)
    by = Window.partitionBy("blob").orderBy("start", F.desc("rank"))
    span = lambda c: F.when(F.col("rank") >= 0, F.col(c))  # noqa: E731  at one start the first kind comes last, and tokens after it
    u = u.withColumns({
        "at": F.last(span("start"), ignorenulls=True).over(by),
        "stop": F.last(span("end"), ignorenulls=True).over(by),
        "held": F.last(span("rank"), ignorenulls=True).over(by),
        "covered": F.max(span("end")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next": F.min(span("start")).over(by.rowsBetween(1, Window.unboundedFollowing)),
    })
    kind = F.when(F.col("at") == F.col("start"), F.element_at(F.array(*map(F.lit, BASE)), F.col("held") + 1))
    inside = F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    t = u.filter("rank < 0").withColumns({"kind": kind, "inside": inside}).filter("kind is not null or not inside")
    w = F.filter(F.split(F.lower("before"), r"\s+"), lambda x: x != "")
    t = t.withColumn("whole", F.col("kind").isNull() | (F.col("stop") == F.col("end")))  # only a whole match lends its shape
    t = t.select("blob", "core", "start", "end", "kind", "whole", F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2).alias("w"))
    words = F.when(F.size("w") > 1, F.array(F.element_at("w", -1), F.concat_ws(" ", "w"))).when(F.size("w") == 1, F.array(F.element_at("w", -1))).otherwise(F.array().cast("array<string>"))
    form = F.when(F.col("whole"), F.array(F.concat(F.lit(SHAPE), shape(F.col("core"))))).otherwise(F.array().cast("array<string>"))
    return t.withColumn("patterns", F.concat(words, form)).drop("w", "whole")


#: Begins the patterns that are shapes; words hold no white space.
SHAPE = "\t"


def shape(token: Column) -> Column:
    """Runs of letters become a, digits 0: 12.ab-7 is 00.a-0."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), "[0-9]", "0")


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"], x["end"], F.lit(rank).alias("rank")))


def bootstrap(tokens: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """blob, start, end, kind, confidence of the tokens that patterns discover; tokens: edges()."""
    graph = staged(tokens.select(F.lower("core").alias("instance"), "kind", F.explode("patterns").alias("pattern")).distinct(), "pii-graph")
    seeds = graph.filter("kind is not null").select("instance", "kind").distinct()
    plain = graph.select("pattern", "instance").distinct()
    all_of = plain.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds.withColumn("c", F.lit(1.0))
    for _ in range(rounds):
        score = plain.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("c").alias("c"), F.count("*").alias("held"))
        score = score.join(score.groupBy("pattern").agg(F.sum("c").alias("known")), "pattern").join(all_of, "pattern")
        conf = F.col("c") / F.when(F.col("pattern").startswith(SHAPE), F.col("known")).otherwise(F.col("n"))
        sure = score.withColumn("conf", conf).filter((F.col("held") >= support) & (F.col("conf") >= confidence)).select("pattern", "kind", "conf")
        sure = staged(sure, "pii-patterns")
        new = plain.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))).alias("c"))
        new = new.filter(F.col("c") >= confidence).join(seeds.select("instance").distinct(), "instance", "left_anti")
        known = staged(seeds.withColumn("c", F.lit(1.0)).unionByName(new), "pii-instances")
    loose = tokens.filter("kind is null").select("blob", "start", "end", F.lower("core").alias("instance"), F.explode("patterns").alias("pattern"))
    fresh = known.join(seeds.select("instance").distinct(), "instance", "left_anti")
    out = loose.join(sure, "pattern").join(fresh, ["instance", "kind"]).groupBy("blob", "start", "end", "kind").agg(F.max("c").alias("confidence"))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, an array of spans for each base kind, and context spans, of every row."""
    found = staged(base_spans(docs), "pii-base")
    tokens = staged(edges(found), "pii-tokens")
    # written, so that the join reads two plain tables and can split the rows of a text that a third of them repeat
    more = staged(bootstrap(tokens).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(CONTEXT)), "pii-context")
    discard(tokens)
    none = F.array().cast("array<struct<start: int, end: int>>")
    return found.select("doc_id", "blob", *BASE).join(more, "blob", "left").select("doc_id", *BASE, F.coalesce(CONTEXT, none).alias(CONTEXT))


def _digest(*kinds: str) -> Column:
    return F.array_join(F.concat(*[_named(k) for k in kinds]), ",")


def _named(k: str) -> Column:
    return F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = personal_data(documents(spark, sf_dir))
    return p.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_digest(*BASE), 256).alias("base_sha256"), _digest(*BASE, CONTEXT).alias("spans"))
