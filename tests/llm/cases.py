"""Odd documents that every operator gets, with columns whose names operators use themselves."""

import random

CLASHING = ["blob", "spans", "fp", "n", "rank", "key", "node", "salt", "h", "w", "matches", "score", "fail_bits", "firsts", "tokens", "piece"]


def odd_texts() -> list[tuple[int, str | None]]:
    rng = random.Random(11)
    words = ["the", "of", "Gates", "wall", "naïve", "東京", "x1", "and", "mit", "license", "cc", "by", "1.2.3.4", "a@b.co", "token=abcdef123", "!!", "|"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(120))) for i in range(20)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a"), (104, "word"), (105, "\x00\x1c é x")]
    rows += [(110, rows[3][1]), (111, rows[3][1]), (3, rows[3][1]), (4, "the same id, another text")]  # copies, a repeated row, a repeated id
    rows += [(120, text(4000)), (121, "z" * 30_000), (122, "ab " * 9000), (123, "line one here\n" * 60)]
    rows += [(None, text(90)), (None, rows[3][1]), (None, None), (5, text(80) + " other"), (None, text(70))]  # no id, and unlike texts under one
    return rows


def frame(spark, rows):
    """A table of documents with clashing extra columns, in three partitions."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, "en", "hot", len(t or ""), *["?"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
