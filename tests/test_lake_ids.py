"""One outcome for each event in the whole table, also after an append that broke off."""

from __future__ import annotations

import pytest

from tapestone.sources import lake


def _outcomes(spark, *rows):
    return spark.createDataFrame(rows, "event_id long, exit_time string, result_r double").selectExpr("event_id", "to_timestamp(exit_time) AS exit_time", "result_r")


def _ids(spark, path):
    return sorted(r["event_id"] for r in spark.read.parquet(path).collect())


def test_an_event_has_one_outcome_in_any_month(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    assert lake.append_outcomes(_outcomes(spark, (1, "2026-01-05", 1.0), (2, "2026-01-06", 1.0)), path) == 2
    with pytest.raises(lake.RejectedRows, match="stored already"):
        lake.append_outcomes(_outcomes(spark, (1, "2026-02-05", -1.0), (3, "2026-02-05", 1.0)), path)
    assert _ids(spark, path) == [1, 2]
    assert lake.append_outcomes(_outcomes(spark, (1, "2026-02-05", -1.0), (3, "2026-02-05", 1.0)), path, known="skip") == 1
    assert _ids(spark, path) == [1, 2, 3]


@pytest.mark.parametrize("written", [False, True])
def test_a_broken_append_can_be_sent_again(spark, tmp_path, monkeypatch, written):
    path, rows = str(tmp_path / "outcomes"), _outcomes(spark, (7, "2026-03-01", 1.0), (8, "2026-04-01", 1.0))
    lake.append_outcomes(_outcomes(spark, (1, "2026-01-05", 1.0)), path)
    writer, parquet = type(rows.write), type(rows.write).parquet

    def breaks(self, to, *more, **named):
        if to == path and not written:
            raise OSError("lost")
        parquet(self, to, *more, **named)
        if to == path:
            raise OSError("lost")

    monkeypatch.setattr(writer, "parquet", breaks)
    with pytest.raises(OSError, match="lost"):
        lake.append_outcomes(rows, path)
    monkeypatch.setattr(writer, "parquet", parquet)
    assert lake.append_outcomes(rows, path, known="skip") == (0 if written else 2)
    assert _ids(spark, path) == [1, 7, 8]


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    _outcomes(spark, (1, "2026-01-05", 1.0)).withColumn("month", lake.month_of("exit_time")).write.partitionBy("month").parquet(path)
    assert lake.append_outcomes(_outcomes(spark, (2, "2026-02-05", 1.0)), path) == 1
    for again in (1, 2):
        with pytest.raises(lake.RejectedRows):
            lake.append_outcomes(_outcomes(spark, (again, "2026-05-05", 1.0)), path)


def test_only_the_buckets_of_the_ids_are_read(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    lake.append_outcomes(_outcomes(spark, *[(i, "2026-01-05", 1.0) for i in range(300)]), path)
    plan = lake.ids_known(_outcomes(spark, (5, "2026-02-05", 1.0)), path, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
