"""Spark against DuckDB on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framewright.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = "change_events activity_timeline stability_windows candidate_handoff transcript_alignment window_decisions pair_scores final_selection page_layout caption_truncate recovery_plan limit_status".split()
CHECKED += "pair_keys redaction redaction_nested absolute_segments absolute_segment_faults raw_transcript_stats alignment_stats context_budget model_inputs model_input_faults analysis_stats decision_stats selected_handoff extraction_stats".split()
CHECKED += "quality_stats group_stats final_stats extraction_plan page_plan_mismatches calibration_sweep dataset_findings temporal_match metric_summary metrics_micro_macro loss_funnel duplicate_groups phase4_quality phase5_quality phase6_quality".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(x) for x in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want and got


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_repetition_stats_floors_the_unrounded_mean(spark, tmp_path):
    """Means next to a step of the floor (25.79396985 and 25.63937008) go to either side of it if they are rounded first."""
    total = {1: (597, 15399), 2: (635, 16281), 3: (4, 100)}
    rows = []
    for k, (n, t) in total.items():
        q = [t // n + (i < t % n) for i in range(n)]
        rows += [(k, float(x)) for x in q]
    spark.createDataFrame(rows, "l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["repetition_stats"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE_SQL["repetition_stats"]).fetchall())
    assert [r[2] for r in got] == [257939, 256394, 250000]
