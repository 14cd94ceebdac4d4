from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: An extra column for each name that operators use within or return.
CLASHES = ("id", "rep", "key", "score", "kept", "shard", "slot", "spans", "digest", "bucket", "block", "length", "n", "words", "a", "b", "x")


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, lang]) as documents, with clashing extra columns."""
    from pyspark.sql import functions as F

    def make(rows, clashes=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic words of invented prose."""
    import random

    def make(seed: int, n: int, letters: str = "aeiou") -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null, empty, blank, very long, repeated and null-id rows."""
    long = prose(99, 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one two"), (6, "one two"), (None, "no id here at all"), (None, None), (7, "!!! ### 123"), (8, "x" * 300_000), (9, "1" * 200_000), (10, "日本語のテキスト 😀 ﬁn")]
