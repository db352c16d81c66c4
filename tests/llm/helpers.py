"""Small tables with every awkward case, and readers of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T

#: Extra columns named like the operators' own.
EXTRA = ["row_id", "kept", "t", "words", "text_key", "recipe", "label", "shard", "host", "line", "n", "band", "node", "u"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i + i // 3) % 24]}{(seed + i) % 13}" for i in range(n))


def awkward_rows() -> list[tuple]:
    long = " ".join(f"w{i % 4001}x{i // 7}" for i in range(60_000))
    near = prose(3, 120)
    return [
        (1, prose(1, 80), "en", "a", 1),
        (1, prose(1, 80), "en", "a", 1),  # a repeated row
        (2, prose(1, 80) + "\n", "en", "a", 1),  # equal without white space, longer
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n\v\f\r ", "en", "b", 7),
        (None, prose(2, 60), "en", "b", 9),
        (None, prose(2, 60), "en", "b", 9),
        (None, None, None, None, None),
        (6, near, "en", "b", 5),
        (7, near.replace("alpha", "alpah", 1), "en", "c", 5),
        (8, near + " tail", "en", "c", 5),
        (9, long, "en", "c", 5),
        (10, "one two three", "en", "c", 5),
        (11, "mail me: a.b@c-d.org or 10.0.0.255, call +1 (234) 555-0199 now\x00 4111 1111 1111 1111", "en", "c", 5),
        (12, "日本語のテキスト。  naïve café 😀 <|endoftext|>", "ja", "d", 5),
        (-5, prose(9, 55), "en", "d", 5),
    ]


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def awkward(spark, extra: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)]) if extra else df


def empty(spark):
    return awkward(spark).limit(0)


def rows(df) -> pd.DataFrame:
    return df.toPandas()


def table(sf: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/{name}.parquet")
