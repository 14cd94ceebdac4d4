"""The SQL of operators against the operators, on texts that the tables lack."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from proofset.llm import exact_dedup, near_dedup, pii

IBANS = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "NL91ABNA0417164300", "GB82WEST12345698765433"]


def by_sql(sql, rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "int64", "text": "object"})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(sql)


def same(found, sql, rows):
    want = by_sql(sql, rows)
    names = sorted(want.columns)
    found = found.withColumnRenamed("id", "doc_id")
    assert sorted(found.columns) == names
    got = sorted(tuple(r) for r in found.select(*names).collect())
    assert got == sorted(want.select(*names).fetchall())


def pii_texts():
    rng = random.Random(11)
    bits = [*IBANS, "ssn 123-45-6789", "123-45-6789", "1123-45-6789", "123-45-67890", "tax id: 987-65-4321", "a.b@c-d.org", "x@y", "10.0.0.256", "host 10.1.2.3", "card 4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "iban", "my account", "é😀", "AB12", "Z", "\n", "-", "7"]
    return ["", None, *bits, *("".join(rng.choice(bits) + rng.choice([" ", "", ", ", "A", "0"]) for _ in range(rng.randrange(2, 14))) for _ in range(400))]


def test_pii(spark, frame):
    rows = list(enumerate(pii_texts()))
    found = pii.find(frame(rows))
    same(found, pii.ORACLE_SQL, rows)
    assert {"iban", "ssn"} <= {span.split(":")[0] for r in found.select("spans").collect() for span in r.spans.split(",")}


@pytest.mark.parametrize("operator, sql", [(near_dedup.near_duplicates, near_dedup.ORACLE_SQL), (exact_dedup.exact_dedup, exact_dedup.ORACLE_SQL)])
def test_copies(spark, frame, prose, operator, sql):
    rng = random.Random(12)
    texts = [None, "", " \t", "one two", "One  two", "one two three four five", "one two three four five six"]
    for seed in range(12):
        words = prose(seed, rng.randrange(5, 80)).split()
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = "changed"
            texts.append(rng.choice([" ", "  ", "\n"]).join(changed))
    rows = list(enumerate(texts))
    same(operator(frame(rows)), sql, rows)
