"""Slot domains, capacities and enumeration sizes over whole tables, counted in another engine without any cap."""

from __future__ import annotations

import pytest

from proofset.operators import taskgen
from proofset.plans import analytics

duckdb = pytest.importorskip("duckdb")

GROWING = {
    "product_name": "SELECT DISTINCT p_name FROM part",
    "customer_name": "SELECT DISTINCT c_name FROM customer",
    "signup_cut": "SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') FROM orders",
    "price_threshold": analytics.THRESHOLDS_SQL,
}


@pytest.fixture(scope="module")
def domains(small):
    connection = duckdb.connect()
    for name in ("customer", "nation", "part", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    found = {slot: {str(v) for v in values} for slot, values in taskgen.SLOT_CONSTANTS.items()}
    for slot, value in connection.execute(analytics.POOLS_SQL).fetchall():
        found.setdefault(slot, set()).add(value)
    return found | {slot: {str(r[0]) for r in connection.execute(sql).fetchall()} for slot, sql in GROWING.items()}


def test_every_value_of_every_slot(spark, small, domains):
    got: dict[str, set] = {}
    for r in analytics.slot_pools(spark, small).collect():
        assert r.value not in got.setdefault(r.slot, set())
        got[r.slot].add(r.value)
    assert got == domains and min(len(got[s]) for s in ("product_name", "customer_name", "signup_cut")) > 15


def test_sizes_have_no_cut_but_the_cap_of_tasks(spark, small, domains):
    golds = {}
    for t in taskgen.TEMPLATES:
        golds[t.family] = len(t.variants)
        for slot in t.slots:
            golds[t.family] *= len(domains[slot])
    openers = {t.family: len(t.openers) for t in taskgen.TEMPLATES}
    assert {r.family: r.capacity for r in analytics.family_capacity(spark, small).collect()} == {f: n * openers[f] for f, n in golds.items()}
    got = {r.family: (r.n, r.n_golds) for r in analytics.enumerate_sizes(spark, small).collect()}
    assert got == {f: (min(n * openers[f], taskgen.ENUMERATION_CAP), n) for f, n in golds.items()}
