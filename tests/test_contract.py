"""Every query of the engine gives the rows of its SQL."""

import duckdb
import pytest

from watchmere.plans import contract, contract_logs, contract_scale  # noqa: F401
from watchmere.streaming import queries as streams

from .conftest import SMALL
from .rows import duck_rows, spark_rows

QUERIES, SQL = contract.QUERIES | streams.QUERIES, contract.SQL | streams.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    rows, names = duck_rows(duck, SQL[name])
    assert sorted(found.columns) == names
    assert spark_rows(found) == rows


def test_chain_against_a_loop(spark):
    raw = contract._raw(spark, SMALL).select("rule_id", "entity", "ts", "emit").collect()
    want, state = [], {}
    for r in sorted(raw, key=lambda r: (r["ts"], r["emit"]["s"])):
        first = state.get(r["entity"])
        if first is None:
            if r["rule_id"] == "outside_failure":
                state[r["entity"]] = r["ts"]
        elif r["rule_id"] == "large_view":
            del state[r["entity"]]
            if (r["ts"] - first).total_seconds() <= 86400:
                want.append((r["entity"], r["ts"].strftime("%Y-%m-%d %H:%M:%S.%f")))
    got = [(r["entity"], r["ts"]) for r in contract.QUERIES["sequence_chain"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
