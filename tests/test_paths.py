"""Pen paths against what must hold exactly."""

import random
from collections import Counter

import duckdb

from plumbline.operators import paths
from plumbline.plans import strokes


def test_resampled_paths_keep_both_ends_exactly(spark):
    rng = random.Random(7)
    made = {p: [(rng.randint(0, 10**6) / 3600.0, rng.randint(0, 10**5) / 100) for _ in range(rng.randint(2, 40))] for p in range(300)}
    df = spark.createDataFrame([(p, k, *xy) for p, points in made.items() for k, xy in enumerate(points)], "path_id long, seq long, x double, y double")
    got = {}
    for r in paths.resampled(df, 50.0).collect():
        got.setdefault(r["path_id"], {})[r["seq"]] = (r["x"], r["y"])
    for p, points in made.items():
        assert sorted(got[p]) == list(range(len(got[p])))
        assert got[p][0] == points[0] and got[p][len(got[p]) - 1] == points[-1]


def test_spans_without_a_start_or_an_end_are_merged_as_by_the_sql(spark, tmp_path):
    rng = random.Random(8)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_shipdate TIMESTAMP, l_linenumber INTEGER)")
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *[f"199{y}-0{m}-11" for y in range(2, 9) for m in range(1, 10)]]), rng.choice([None, 1, 2, 3, 30])) for _ in range(150)]
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", [*rows, (7, None, 1), (7, None, 2), (8, "1995-01-01", None), (8, "1996-01-01", None)])
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in strokes.merged_intervals(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(con.execute(strokes.MERGE_SQL).fetchall())
    assert [r for r in got if r[0] == 7] == [(7, 1, None, None, 2)]


def test_events_without_user_or_time_and_early_ones_are_resampled_as_by_the_sql(spark, tmp_path):
    rng = random.Random(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    at = lambda k: f"1969-12-31 {k % 24:02}:30:00.{k % 7}"
    rows = [(k, None if rng.random() < 0.1 else at(rng.randrange(1000)), rng.choice([1, 2, 3, None]), rng.choice([None, 10.25, 80.5, 400.0, 7.0])) for k in range(120)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in strokes.resampled(spark, str(tmp_path)).collect()]
    assert len(got) > 100 and Counter(got) == Counter(con.execute(strokes.RESAMPLE_SQL).fetchall())
