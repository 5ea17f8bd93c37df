"""Every query that has an SQL twin, against DuckDB on the smallest tables; the others must run."""

import pytest

from tarnwell.plans import catalog
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert not differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_set_operations_have_rows(con):
    assert con.execute(f"select count(*) from ({catalog.oracle_sql()['set_operations']})").fetchall()[0][0] > 0


def test_breakers_step_by_step(spark, con):
    state, want = {}, {}
    for user, event, at, bad in con.execute("select user_id::varchar, event_id, epoch_us(ts) / 1e6, event_type = 'error' from events order by ts, event_id").fetchall():
        mode, fails, since = state.get(user, ("closed", 0, 0.0))
        if mode == "open" and at - since >= 3600:
            mode = "halfOpen"
        if bad:
            fails += 1
            if mode == "halfOpen" or (mode == "closed" and fails >= 2):
                mode, since = "open", at
        elif mode != "open":
            mode, fails = "closed", 0
        state[user], want[event] = (mode, fails, since), (user, mode)
    for name in ("breaker_states", "stream_breakers"):
        assert {r.event_id: (r.signal, r.state) for r in catalog.queries()[name](spark, SF).collect()} == want
