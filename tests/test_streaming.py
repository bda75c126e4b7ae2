"""Streams in several micro-batches give what the batch recursions give."""

import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import recursive
from trajspark.streaming import stateful as S

SCHEMA = "k string, n long, ts timestamp, lat double, lon double, v double"


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    r = random.Random(0)
    rows, base = [], 1_773_553_223
    for n in range(60):
        for k in ("a", "b"):
            rows.append((k, n, base + n, 17 + r.uniform(0, 4e-4), 78.0, float(r.randint(0, 9))))
    folder = str(tmp_path_factory.mktemp("in"))
    df = spark.createDataFrame(rows, "k string, n long, s long, lat double, lon double, v double").select("k", "n", F.timestamp_seconds("s").alias("ts"), "lat", "lon", "v")
    for i in range(3):  # three files, in the order of time
        df.filter((F.col("n") >= 20 * i) & (F.col("n") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(folder)
    return folder, {k: [x for x in rows if x[0] == k] for k in ("a", "b")}


def run(spark, recording, tmp_path, new, step):
    stream = S.track_stream(S.replay(spark, recording[0], SCHEMA), ["k"], ["n"], "ts", new, step)
    S.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    return {k: [r[next(iter(new))] for r in rows if r.k == k] for k in ("a", "b")}


def test_gate(spark, recording, tmp_path):
    got = run(spark, recording, tmp_path, {"kept": "boolean"}, S.gate_step())
    assert got == {k: recursive.accepted([(r[3], r[4]) for r in rows]) for k, rows in recording[1].items()}
    assert not all(got["a"])


def test_filters_throttle_and_change(spark, recording, tmp_path):
    got = run(spark, recording, tmp_path / "1", {"low": "double"}, S.low_pass_step("v", "low"))
    assert got == {k: recursive.low_pass([r[5] for r in rows]) for k, rows in recording[1].items()}
    got = run(spark, recording, tmp_path / "2", {"kept": "boolean"}, S.throttle_step("n", 7))
    assert got == {k: recursive.throttled([r[1] for r in rows], 7) for k, rows in recording[1].items()}
    got = run(spark, recording, tmp_path / "3", {"changed": "boolean"}, S.change_step(["v"]))
    assert got == {k: [i == 0 or rows[i][5] != rows[i - 1][5] for i in range(len(rows))] for k, rows in recording[1].items()}


def test_windows(spark, recording, tmp_path):
    import numpy as np

    got = run(spark, recording, tmp_path / "1", {"deviation": "double"}, S.time_window_step("n", "v"))
    for k, rows in recording[1].items():
        assert got[k] == pytest.approx([np.std([x[5] for x in rows if r[1] - 2 <= x[1] <= r[1]]) for r in rows])
    got = run(spark, recording, tmp_path / "2", {"trailing": "double"}, S.distance_window_step("v"))
    for k, rows in recording[1].items():
        at = np.concatenate([[0], np.cumsum([recursive.metres(a[3], a[4], b[3], b[4]) for a, b in zip(rows, rows[1:])])])
        want = [np.sqrt(np.mean([x[5] ** 2 for x, m in zip(rows, at) if at[i] - 100 <= m <= at[i]])) for i in range(len(rows))]
        assert got[k] == pytest.approx(want)


def test_high_pass_state(spark, recording, tmp_path):
    got = run(spark, recording, tmp_path, {"high": "double"}, S.high_pass_step("v", "high"))
    assert got == {k: pytest.approx(recursive.high_pass([r[5] for r in rows])) for k, rows in recording[1].items()}
