"""Awkward documents that every operator must take."""

import random

SYLLABLES = "the ing er on re th an ti st en nd ou ea ha wh sh".split()


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(word(rng) for _ in range(n))


#: (doc_id, text): null and empty text, blanks, marks, repeats, no id, one very long run, one very long text
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "!!! ???"), (5, "a  b   c "), (5, "a  b   c "), (None, "no id here"), (6, "x" * 30_000),
    (7, prose(9_000, 7)), (8, "İstanbul ΣΑΣ ﬁ naïve 中文 😀 \x1c\xa0½"), (9, "don't 'sabre 're!l <|endoftext|> ▁▁ <s>"), (10, "one\n\ntwo\r\nthree\n"),
]
SCHEMA = "doc_id long, text string"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clash(df, *names):
    """The table with further columns, some named like outputs."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in [*names, "other"]})
