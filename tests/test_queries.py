"""Every registered query of the detector operators against its SQL."""

import pytest

import __spark_entry__
from tickflow.operators import calibrate
from tickflow.plans import queries, streams  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_order_after_calibration_equals_plain_python(spark, sf_dir):
    """Hits in order of arrival: each waits for an isochron that reaches it, is translated by the oldest of the
    last 20 that does, and is kept unless an earlier one came out later."""
    found = {r.mbid: (r.n, r.n_kept) for r in queries.QUERIES["t05_order_after_calibration"](spark, sf_dir).collect()}
    clocks = {(r.mbid, r.seq): r.clk for r in queries.Views(spark, sf_dir).tcal.selectExpr("mbid", "seq", "(dom_rx + (k - 60) * 1000000L) * 250 as clk").collect()}
    channels: dict[int, list] = {}
    for r in queries.stamps(queries.Views(spark, sf_dir)).collect():
        channels.setdefault(r.mbid, []).append(r)
    want = {}
    for mbid, rows in channels.items():
        state, isochrons, waiting, times = (0, None, None, (None, 0)), [], [], []
        for r in sorted(rows, key=lambda r: r.seq):
            for step in ("hit", "tcal"):
                if step == "hit":
                    waiting.append(clocks[r.mbid, r.seq])
                else:
                    state, out = calibrate.chain_step(state, r)
                    isochrons = (isochrons + [out])[-20:] if out[2] == "accepted" else isochrons
                while waiting and isochrons and waiting[0] <= isochrons[-1][4]:
                    clock = waiting.pop(0)
                    i = [i for i in isochrons if clock <= i[4]][0]
                    times.append(i[5] + (clock - i[6]) + int(i[7] * (clock - i[6])) + i[9])
        if times:
            want[mbid] = len(times), sum(all(t >= u for u in times[:k]) for k, t in enumerate(times))
    assert found == want and any(kept < n for n, kept in want.values())


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
