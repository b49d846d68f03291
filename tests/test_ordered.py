"""Block-parallel helpers agree with plain numpy for any block size."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.operators import decoding, ordered, relations
from nightframe.operators.scan import Gate, Jump, Slew, Smooth, scan
from nightframe.operators.scoring import transition_penalties
from nightframe.operators.signal import RR_ALPHA, RR_CONF_MIN, RR_RANGE
from nightframe.schema import CLASSES


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for key in ("a", "b"):
        idx = np.cumsum(rng.integers(1, 4, 60))
        out += [(key, int(i), float(rng.integers(0, 12))) for i in idx]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(3)


@pytest.mark.parametrize("size", [5, 16, 4096])
def test_neighbours_position_and_totals(spark, rows, size):
    df = ordered.with_neighbours(frame(spark, rows), ["k"], ["i"], ordered.block_of("i", size), ["i", "v"], next_="next")
    df = ordered.with_position(df, ["k"], ["i"], ordered.block_of("i", size))
    got = {(r.k, r.i): r for r in df.collect()}
    assert len(got) == len(rows)
    for key in ("a", "b"):
        mine = sorted((i, v) for k, i, v in rows if k == key)
        for n, (i, v) in enumerate(mine):
            r = got[key, i]
            assert r.pos == n
            assert (None if r.prev is None else tuple(r.prev)) == (mine[n - 1] if n else None)
            assert (None if r.next is None else tuple(r.next)) == (mine[n + 1] if n + 1 < len(mine) else None)


@pytest.mark.parametrize("size", [7, 4096])
def test_frame_over_index_range(spark, rows, size):
    df = ordered.with_frame(frame(spark, rows), ["k"], "i", 4, 2, {"s": F.sum("v"), "n": F.count("v")}, size)
    got = {(r.k, r.i): (r.s, r.n) for r in df.collect()}
    for k, i, _ in rows:
        near = [v for kk, j, v in rows if kk == k and i - 4 <= j <= i + 2]
        assert got[k, i] == (sum(near), len(near))


def test_dense_neighbours(spark):
    data = [("a", i, float(i * i % 7)) for i in range(40)]
    df = ordered.with_neighbours(frame(spark, data), ["k"], ["i"], "i", ["v"], next_="next", dense=8)
    for r in df.collect():
        assert (r.prev.v if r.prev else None) == (data[r.i - 1][2] if r.i else None)
        assert (r.next.v if r.next else None) == (data[r.i + 1][2] if r.i < 39 else None)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.995, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(3)
    data = {k: np.round(rng.normal(0, s, 200), 2) for k, s in (("a", 1e-3), ("b", 50.0))}
    df = frame(spark, [(k, n, float(v)) for k, vs in data.items() for n, v in enumerate(vs)])
    both = ordered.exact_quantiles(df, ["k"], "v", {"p": q}).join(
        ordered.exact_quantiles(df, ["k"], "v", {"r": q}, method="lower_rank"), "k"
    )
    for r in both.collect():
        assert r.p == pytest.approx(np.percentile(data[r.k], 100 * q))
        assert r.r == sorted(data[r.k])[int(q * 199)]


def test_running_max_without_keys(spark):
    data = [("a", i, float((i * 37) % 50)) for i in range(30)]
    df = frame(spark, data).withColumn("b", F.floor(F.col("i") / 4))
    got = {r.i: r.m for r in ordered.running_max(df, [], ["i"], "b", {"m": F.col("v")}).collect()}
    best = -1.0
    for _, i, v in data:
        best = max(best, v)
        assert got[i] == best


def capped(values, limit):
    prev, out = None, []
    for x in values:
        if np.isnan(x):
            prev = None
            out.append(None)
            continue
        prev = x if prev is None else min(max(x, prev - limit), prev + limit)
        out.append(prev)
    return out


def values(rng, n, nulls):
    xs = rng.uniform(30, 220, n)
    if nulls:
        xs[rng.integers(0, n, nulls)] = np.nan
    return xs


def gated(rates, confs):
    prev, out = None, []
    for r, c in zip(rates, confs):
        weak = c < RR_CONF_MIN
        x = RR_ALPHA * r + (1 - RR_ALPHA) * prev if weak and prev else r
        prev = x if r > 0 and not (weak and (c <= 0 or not prev)) and RR_RANGE[0] <= x <= RR_RANGE[1] else None
        out.append(prev)
    return out


def started(times, closed, span):
    start, out = None, []
    for t, c in zip(times, closed):
        start = t if start is None or t - start > span else start
        out.append(start)
        start = None if c else start
    return out


@pytest.mark.parametrize("size", [4, 9, 25, 4096])
def test_scan_in_blocks_equals_sequential(spark, size):
    """Keys with and without resets, over one to many blocks."""
    rng = np.random.default_rng(11)
    for nulls, limit in ((0, 15), (0, 2), (6, 15)):
        series = {key: values(rng, 50, nulls if key != "c" else 0) for key in "abc"}
        data = [(k, i, None if np.isnan(x) else float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
        got = {(r.k, r.i): r.y for r in scan(frame(spark, data), ["k"], "i", Slew("v", limit), "y", size=size).collect()}
        soft = {(r.k, r.i): r.y for r in scan(frame(spark, data), ["k"], "i", Smooth("v", 0.3), "y", size=size).collect()}
        for key, xs in series.items():
            smooth = None
            for i, y in enumerate(capped(xs, limit)):
                assert got[key, i] == (None if y is None else pytest.approx(y))
                smooth = None if np.isnan(xs[i]) else xs[i] if smooth is None else 0.3 * xs[i] + 0.7 * smooth
                assert soft[key, i] == (None if smooth is None else pytest.approx(smooth))


@pytest.mark.parametrize("size", [4, 25, 4096])
def test_gates_and_jumps_in_blocks_equal_sequential(spark, size):
    rng = np.random.default_rng(12)
    rates, confs = rng.uniform(2, 60, 60), np.where(rng.random(60) < 0.9, 0.2, 0.9)
    rates[rng.integers(0, 60, 3)] = 0
    rates[:30], confs[:30] = rng.uniform(8, 30, 30), 0.2  # only blending rows in the first blocks, after the first
    confs[0], rates[0] = 0.9, 15
    data = [("a", i, float(r), float(c)) for i, (r, c) in enumerate(zip(rates, confs))]
    df = spark.createDataFrame(data, "k string, i int, r double, c double")
    got = [r.y for r in scan(df, ["k"], "i", Gate("r", "c", RR_CONF_MIN, RR_ALPHA, *RR_RANGE), "y", size=size).orderBy("i").collect()]
    assert got == [None if x is None else pytest.approx(x) for x in gated(rates, confs)]
    times = np.cumsum(rng.integers(0, 9, 80))
    for ends in (np.zeros(80, int), (rng.random(80) < 0.04).astype(int)):
        rows = [("a", i, int(t), int(e)) for i, (t, e) in enumerate(zip(times, ends))]
        df = spark.createDataFrame(rows, "k string, i int, t long, e int")
        got = [r.y for r in scan(df, ["k"], "i", Jump("t", 30, "e"), "y", size=size).orderBy("i").collect()]
        assert got == started(times, ends, 30)


def test_repeated_rows_stay_single_rows(spark):
    rows = [("a", 0, 50.0, "x"), ("a", 1, 90.0, "x"), ("a", 1, 90.0, "x"), ("a", 2, 60.0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double, note string")
    out = scan(df, ["k"], "i", Slew("v", 10.0), "y", size=2)
    assert out.columns == ["k", "i", "v", "note", "y"]
    assert [(r.i, r.y, r.note) for r in out.orderBy("i", "y").collect()] == [(0, 50.0, "x"), (1, 60.0, "x"), (1, 70.0, "x"), (2, 60.0, None)]
    jump = scan(df.withColumn("s", F.col("i") * 10), ["k"], "i", Jump("s", 15), "y")
    assert [r.y for r in jump.orderBy("i").collect()] == [0, 0, 0, 20]
    probs = spark.createDataFrame([("a", i, [0.7, 0.1, 0.1, 0.1], n) for i, n in ((0, 1), (1, 1), (1, 1), (2, 5))], "k string, epoch_index int, probabilities array<double>, n int")
    got = decoding.viterbi(probs, ["k"])
    assert got.columns == ["k", "epoch_index", "probabilities", "n", "decoded"] and got.count() == 4


def best_score(probs, path, cost):
    score = sum(np.log(max(probs[t][s], 1e-12)) for t, s in enumerate(path))
    return score - sum(cost[CLASSES[a], CLASSES[b]] for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("size", [2, 3, 4096])
def test_viterbi_against_brute_force(spark, size):
    rng = np.random.default_rng(5)
    cost = transition_penalties(CLASSES)
    nights = {k: rng.dirichlet(np.ones(4), 7) for k in ("a", "b")}
    df = spark.createDataFrame(
        [(k, i, [float(x) for x in p]) for k, ps in nights.items() for i, p in enumerate(ps)],
        "k string, epoch_index int, probabilities array<double>",
    )
    got = {}
    for r in decoding.viterbi(df, ["k"], size=size).orderBy("k", "epoch_index").collect():
        got.setdefault(r.k, []).append(CLASSES.index(r.decoded))
    for k, probs in nights.items():
        best = max(best_score(probs, p, cost) for p in itertools.product(range(4), repeat=7))
        assert best_score(probs, got[k], cost) == pytest.approx(best)


def test_quantiles_over_all_of_a_doubles_range(spark):
    """Equal leading bits, both signs, zeros, the smallest and largest numbers; null keys and unknown values."""
    rng = np.random.default_rng(3)
    series = {
        "dense": 1 + rng.integers(0, 4000, 3000) * 2.0**-52,
        "octave": rng.uniform(1, 2, 3000),
        "signs": np.concatenate([rng.normal(0, 1e-3, 500), np.zeros(50), -rng.exponential(1e9, 500)]),
        "scales": np.concatenate([10.0 ** rng.uniform(-320, 308, 400), [5e-324, 1.7976931348623157e308, 2.0**-1022]]),
        "powers": 2.0 ** rng.integers(-60, 60, 200),
        "one": np.array([7.5]),
        None: rng.normal(0, 1, 11),
    }
    rows = [(k, float(x)) for k, xs in series.items() for x in xs] + [("dense", None), ("dense", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["k"]: r for r in ordered.exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {*series, "none"} and all(got["none"][name] is None for name in wanted)
    for k, xs in series.items():
        for name, q in wanted.items():
            s = np.sort(xs)
            a, b = s[int(np.floor(q * (len(s) - 1)))], s[int(np.ceil(q * (len(s) - 1)))]
            assert got[k][name] == pytest.approx(a + (b - a) * (q * (len(s) - 1) % 1), rel=1e-12, abs=0), (k, name)
    lower = ordered.exact_quantiles(df.filter("k = 'octave'"), [], "v", wanted, method="lower_rank").collect()[0]
    s = np.sort(series["octave"])
    assert [lower[n] for n in wanted] == [s[int(q * (len(s) - 1))] for q in wanted.values()]


def test_positions_in_ranges_cut_where_the_rows_are(spark):
    """One key and one value hold most rows; null keys; no keys at all."""
    rng = np.random.default_rng(8)
    rows = [("hot", 5.0 if rng.random() < 0.7 else float(rng.random()), i) for i in range(3000)]
    rows += [(None, float(i % 7), i) for i in range(50)] + [("b", None, 1), ("b", 2.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(5)
    got = ordered.ranked_in_ranges(df, ["k"], ["v", "id"]).collect()
    for key in ("hot", None, "b"):
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.v is not None, r.v or 0, r.id))
        assert [r.pos for r in mine] == list(range(len(mine)))
    whole = sorted(ordered.ranked_in_ranges(df, [], ["id", "k"]).collect(), key=lambda r: (r.id, r.k is not None, r.k or ""))
    assert [r.pos for r in whole] == list(range(len(rows)))


def test_overlap_sweep_of_a_crowded_evening(spark, monkeypatch):
    rng = np.random.default_rng(9)
    spans = [(i, int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 4000, 1500), rng.integers(0, 9, 1500)))]
    spans += [(2000 + i, 4100, 4100 + i) for i in range(300)] + [(3000, 0, 2), (3001, 4405, 4406)]
    df = spark.createDataFrame([*spans, (4000, None, 7)], "r int, s int, e int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    try:
        got = {r.r: r.time_group for r in relations.overlap_groups(df, "r", "s", "e").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    reach, group, want = None, 0, {4000: None}
    for r, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        group += reach is None or s > reach
        reach = e if reach is None else max(reach, e)
        want[r] = group
    assert got == want and group > 100
