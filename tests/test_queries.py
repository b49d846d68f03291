"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")

SAMPLE = [
    "agg_02_per_class_metrics", "agg_07_report_by_scope", "agg_17_daily_feature_stats", "agg_26_clinical_agreement",
    "seq_03_transition_entropy", "seq_11_viterbi_decode", "win_02_hypnogram", "win_04_windows_zero_fill",
    "exp_10_decode_features", "dst_07_purge_gap", "dst_08_grouped_stratification", "dst_11_snapshot_digest",
    "drf_05_overall_severity", "mod_07_replay_summary", "ups_04_upsert_predictions", "ses_01_recording_sessions",
    "sig_17_edr_grid", "sig_22_rate_gating", "src_07_stage_events", "src_09_flash_unpack", "str_06_sync_status",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", ["agg_24_recording_summary", "seq_04_fragmentation"])
def test_partition_count_does_not_matter(spark, name):
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(entry.queries()[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert compare(*results) == "ok"
