"""Every query against its SQL; layouts against plain windows; causality by truncation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapestone import queries as q
from tapestone.functions import indicators as ind
from tapestone.operators import events as ev
from tapestone.operators import groups as grp
from tapestone.operators import models
from tapestone.operators import reports as rep
from tapestone.plans import layout
from tapestone.sources import bars as src

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return round(float(v), 5) + 0.0


@pytest.fixture(scope="module")
def results(spark):
    """Rows of every query on whole tables; they are many small jobs, so several run at a time."""
    def run(name):
        try:
            rows = q.QUERIES[name](spark, SF)
            names = sorted(rows.columns)
            return names, [tuple(r) for r in rows.select(*names).collect()]
        except Exception as e:  # the test of this query tells it
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(q.QUERIES, pool.map(run, q.QUERIES), strict=True))


def rows_of(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    assert results[name][1], "a query without rows tests nothing"
    return results[name]


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(results, duck, name):
    names, rows = rows_of(results, name)
    cells = lambda data: sorted(str(tuple(_plain(x) for x in r)) for r in data)
    sql = f"SELECT {', '.join(f'{chr(34)}{n}{chr(34)}' for n in names)} FROM ({q.ORACLE[name]})"
    assert cells(rows) == cells(duck.sql(sql).fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_runs(results, name):
    rows_of(results, name)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def bars(spark):
    return src.bars_ev(spark, "/root/testdata/sf0.001", "1 hour").persist()


def test_halo_blocks_match_plain_windows(bars):
    df, w = layout.blocked(bars, 20, 0, block=25)
    a = layout.own_rows(df.withColumn("m", F.avg("close").over(w.rowsBetween(-19, 0))))
    plain = bars.withColumn("m2", F.avg("close").over(Window.partitionBy("symbol").orderBy("bar").rowsBetween(-19, 0)))
    assert a.count() == bars.count()
    assert a.join(plain.select("symbol", "bar", "m2"), ["symbol", "bar"]).filter("abs(m - m2) > 1e-9").count() == 0


def test_affine_scan_is_the_recurrence(bars):
    got = {(r["symbol"], r["bar"]): r["y"] for r in layout.affine_scan(bars, 0.9, "close", "y", block=7).collect()}
    last: dict = {}
    for r in bars.orderBy("symbol", "bar").collect():
        y = last[r["symbol"]] = 0.9 * last[r["symbol"]] + 0.1 * r["close"] if r["symbol"] in last else r["close"]
        assert abs(got[r["symbol"], r["bar"]] - y) < 1e-9


def test_cooldown_is_greedy(spark):
    at = [0, 2, 3, 5, 6, 9, 20, 22, 26, 27]
    got = layout.greedy_cooldown(spark.createDataFrame([("a", x) for x in at], "symbol string, bar long"), 3, ("symbol",)).collect()
    kept: list[int] = []
    for x in at:
        if not kept or x - kept[-1] > 3:
            kept.append(x)
    assert sorted(r["bar"] for r in got) == kept


def test_replay_caps_open_trades(spark):
    trades = [(i, "a", i * 2, i * 2 + 5) for i in range(20)]
    rows = grp.exposure_replay(spark.createDataFrame(trades, "event_id long, symbol string, entry_bar long, exit_bar long"), 2).collect()
    taken: list = []
    for i, _, a, z in trades:
        if sum(y > a for _, y in taken) < 2:
            taken.append((i, z))
    assert {r["event_id"] for r in rows if r["executed"]} == {i for i, _ in taken}


def test_groups_are_components(spark):
    rows = [(i, "a", "long", b, 100.0 + p, 1.0) for i, (b, p) in enumerate([(0, 0), (3, 0.5), (6, 1.0), (30, 0), (31, 9)])]
    df = spark.createDataFrame(rows, "event_id long, symbol string, direction string, bar long, close double, atr double")
    assert {r["event_id"]: r["group_id"] for r in grp.correlated_groups(df, 4, 1.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_long_groups_stay_whole(spark):
    """A run of 200 events, each near only to the next, is one group."""
    df = spark.createDataFrame([(i, "a", "long", 10 * i, 100.0, 1.0) for i in range(200)], "event_id long, symbol string, direction string, bar long, close double, atr double")
    grouped = grp.correlated_groups(df, 12, 1.0)
    assert {r["group_id"] for r in grouped.collect()} == {0}
    assert grp.best_of_group(grouped, F.col("close")).filter("discard_reason is null").count() == 1
    assert [r["n"] for r in grp.confluence(grouped, F.col("close")).collect()] == [200]


def test_bootstraps_of_rare_losses(spark):
    """Resamples without a loss count as infinite; a loss in a few resamples of a hundred still gives bounds."""
    df = spark.createDataFrame([("a", i, -1.0 if i == 0 else 1.0) for i in range(100)] + [("b", i, 1.0) for i in range(100)], "symbol string, i long, result_r double")
    low = {r["symbol"]: r["pf_low"] for r in rep.bootstrap_pf(df, ["symbol"], "i").collect()}
    assert low["b"] == math.inf and 20 < low["a"] < 60
    bounds = {r["symbol"]: r for r in rep.block_bootstrap_pf(df, ["symbol"], ["i"]).collect()}
    assert bounds["b"]["pf_low"] is None and bounds["a"]["pf_high"] == 99


def test_truncation_changes_nothing_known(bars):
    """Sweeps up to a bar are the same on a prefix of the series."""
    rows = lambda b: {(r["symbol"], r["bar"], r["direction"]) for r in ev.sweep_rows(ev.sweep_flags(ind.add_rolling(ind.add_atr(b)))).collect()}
    whole, prefix = rows(bars), rows(bars.filter("bar <= 80"))
    assert prefix == {r for r in whole if r[1] <= 80}


def test_regime_blocks_agree(bars):
    x = bars.select("symbol", "bar", (F.col("close") / 100).alias("x"))
    a, b = (models.regime_filter(x, (0.5, 1.0), (0.3, 0.5), block=n) for n in (8, 4096))
    assert a.join(b.withColumnRenamed("state", "s2").withColumnRenamed("confidence", "c2"), ["symbol", "bar"]).filter("state <> s2 or abs(confidence - c2) > 1e-9").count() == 0


def test_export_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2026.01.02\t01:00:00\t1,5\t2,5\t1,0\t2,0\t7\t0\t1\n")
    r = src.read_export(spark, str(tmp_path / "x.csv"), "S", "M15", 3).first()
    assert (r["open"], r["high"], r["volume"], r["ts"].hour, r["ts"].day) == (1.5, 2.5, 7.0, 22, 1)


def test_append_guard(spark, tmp_path):
    from tapestone.streaming.bars import append_new

    path = str(tmp_path / "lake")
    rows = spark.sql("select id as event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts from range(10)")
    append_new(rows, path)
    append_new(rows.unionByName(spark.sql("select 99L as event_id, timestamp'2024-02-01' as ts")), path)
    assert spark.read.parquet(path).count() == 11
