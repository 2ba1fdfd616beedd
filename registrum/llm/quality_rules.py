"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores one failure bit per rule and the measurements. Policies are
versioned bit masks applied to stored bits, and ablations are bitwise aggregations over the few distinct bit patterns, so
neither reads the texts again. Only DataFrame functions are used.

Defined cases: a null or empty text has zero for every measurement and fails FEW_WORDS; repeated rows give repeated ledger
rows; a row is judged by its text alone, whatever its doc_id; extra columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import doc_texts, documents, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name and failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "n_words > 0 and (2 * word_chars < 5 * n_words or word_chars > 15 * n_words)"),
    ("shouting", "10 * n_upper > 4 * word_chars"),
    ("exclamations", "4 * n_exclaim > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2024-1", tuple(BIT))


def _often(c: str) -> Column:
    """How often c stands in column m."""
    return (F.length("m") - F.length(F.replace(F.col("m"), F.lit(c), F.lit("")))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and the measurements.

    n_repeat_words counts word positions covered by a 3-word window that occurs at least twice in the text. Windows are
    compared by a 64-bit hash; texts whose windows are all distinct skip the sort. Symbols and capitals are folded to one
    character each in a single pass over the text; each class is then counted by a byte search.
    """
    d = doc_texts(docs)
    word = F.split("text", r"[\x20\x09-\x0D]+")
    line = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    folded = F.translate("text", SYMBOLS[1:] + UPPER[1:], SYMBOLS[0] * (len(SYMBOLS) - 1) + UPPER[0] * (len(UPPER) - 1))
    d = d.select("doc_id", folded.alias("m"), F.array_remove(word, "").alias("w"), line.alias("l"))
    d = d.select("doc_id", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _often(SYMBOLS[0]).alias("n_symbols"), _often(UPPER[0]).alias("n_upper"), _often("!").alias("n_exclaim"), "w", "l")
    d = d.withColumns({"n_words": F.size("w").cast("long"), "n_lines": F.size("l").cast("long"), "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long")})
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("h", F.when(F.size("w") >= 3, window).otherwise(none)).drop("w", "l")
    ranked = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ranked)).drop("h")
    twin = F.transform("s", lambda x, i: F.when((F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]), x["i"]))
    d = d.withColumn("p", F.sort_array(F.array_compact(twin))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def ledger(docs: DataFrame) -> DataFrame:
    """measure() plus fail_bits: bit i is set where rule i of RULES fails."""
    bits = None
    for name, fails in RULES:
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs).withColumn("fail_bits", bits)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """ledger() written once: policies and ablations read it, and filters on its bits don't repeat the rules' expressions."""
    return staged(ledger(docs), "quality-ledger")


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds policy (version) and kept: no rule of the policy failed."""
    return rows.withColumns({"policy": F.lit(policy.version), "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it, and kept if it were left out.

    Documents are first counted by bit pattern, at most 2 ** len(RULES) rows; rules are applied to those.
    """
    n = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    n = n.select("n", held.alias("held"), rule).select("n", "held", "r.rule", "r.bit")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return n.groupBy("rule").agg(
        some(F.col("held").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        some(F.col("held") == F.col("bit"))("n_only"),
        some(F.col("held").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"),
    )


def sole_rule(policy: Policy) -> Column:
    """The rule of the policy without which a row that fails would be kept; null if there is none or the row is kept."""
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    return F.coalesce(*[F.when(held == BIT[r], F.lit(r)) for r in policy.rules])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies and each row's ablation, from one stored ledger."""
    rows = stored_ledger(documents(spark, sf_dir))
    rows = apply_policy(rows, STRICT).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"), "fail_bits", "policy", sole_rule(STRICT).alias("sole_rule"))


_SPLIT = r"[\x20\x09-\x0D]+"
OP9_SQL = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{_SPLIT}'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_SPLIT}', '', 'g')) > 0) l from d),
u as (select rid, unnest(w) a, generate_subscripts(w, 1) i from w),
g as (select rid, i, a, lead(a, 1) over o b, lead(a, 2) over o c from u window o as (partition by rid order by i)),
k as (select rid, i, count(*) over (partition by rid, a, b, c) n from g where c is not null),
p as (select rid, count(distinct i + j) covered from k, (values (0), (1), (2)) v(j) where n > 1 group by rid),
m as (select rid, doc_id, len(w)::bigint n_words, length(regexp_replace(t, '{_SPLIT}', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::bigint n_symbols, length(regexp_replace(t, '[^{UPPER}]', '', 'g'))::bigint n_upper,
  length(regexp_replace(t, '[^!]', '', 'g'))::bigint n_exclaim, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
  coalesce(covered, 0)::bigint n_repeat_words from w left join p using (rid)),
b as (select *, ({" + ".join(f"(case when {c} then {1 << i} else 0 end)" for i, (_, c) in enumerate(RULES))})::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  fail_bits = 0 kept, fail_bits, '{STRICT.version}' policy, case fail_bits {" ".join(f"when {b} then '{r}'" for r, b in BIT.items())} end sole_rule from b"""
