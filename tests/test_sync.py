"""Exact quantiles by selection, the log of corrections and the deferral of messages, against slow versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.operators import sync, transport


@pytest.mark.parametrize("ranked", [20_000, 5])
def test_quantiles_are_those_of_all_values(spark, ranked):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.standard_normal(5_001), "ties": rng.integers(0, 3, 4_000).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 4.0]), None: rng.exponential(size=801), "skewed": np.concatenate([np.zeros(3_000), rng.lognormal(3, 4, 1_000)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r.g, r.q): r.quantile for r in sync.quantiles(df, "v", "g", at, ranked).collect()}
    want = {(r.g, q): v for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p")).collect() for q, v in zip(at, r.p, strict=True)}
    assert got == want


def test_corrections_do_not_move_the_duration_to_hold(spark):
    durations = [(0, 5), (0, 7), (40, 1), (40, 2), (39, 3), (39, 4), (41, 9), (40, 1)] + [(30 + i, 0) for i in range(12)]
    rows = spark.createDataFrame([(1, i, d, float(t), i != 3) for i, (d, t) in enumerate(durations)], "pid long, off long, d long, t double, ready boolean")
    last, history, want = None, [], []
    for i, (d, t) in enumerate(durations):
        if i == 3:
            continue
        if last is None:
            want.append((i, "INITIAL_DIFF", float(t), []))
            last = d
        if last != 0 and d != last:
            history = [*history, float(last - d)][-10:]
            want.append((i, "CORRECTION", float(last - d), history))
        else:
            last = d
    got = sync.correction_log(rows, "pid", "off", F.col("ready"), "d", "t").orderBy("off", F.desc("event")).collect()
    assert [(r.off, r.event, r.value, r.last_ten) for r in got] == want


def test_small_audio_waits_for_the_next_message_once(spark):
    messages = [(8, 20), (8, 20), (8, 100), (9, 20), (8, 30), (9, 300), (8, 127), (8, 128), (8, 1), (8, 1), (8, 1)]
    rows = spark.createDataFrame([(0, i, t, n, 12) for i, (t, n) in enumerate(messages)], "s long, i long, packet_type int, size int, head int")
    held, want = None, []
    for kind, size in messages:
        if held is None and kind == 8 and size < 128:
            held = size + 12
            want.append((True, False, 0))
            continue
        joined = held is not None and held + size + 12 <= 128
        want.append((False, joined, -(-size // 128) + (held is not None and not joined)))
        held = None
    got = [(r.deferred, r.joined, r.sends) for r in transport.rtmp_sends(rows, "s", "i").orderBy("i").collect()]
    assert got == want
