"""Expressions and kernels against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.functions import expr
from epochloom.operators import backbone, checks, epochs, preprocess, spectral


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def numpy_corr(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    ok = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[ok], b[ok]
    if len(a) < 2:
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


@pytest.mark.parametrize(
    "a,b",
    [([1.0, 2, 3], [2.0, 4, 7]), ([1.0, float("nan"), 3, 5], [1.0, 2, 0, float("nan")]), ([1.0, 1, 1], [1.0, 2, 3]), ([1.0], [2.0]), ([float("nan")] * 3, [1.0, 2, 3])],
)
def test_safe_corr(spark, a, b):
    got = one(spark, a=[float(x) for x in a], b=[float(x) for x in b]).select(expr.safe_corr("a", "b")).first()[0]
    assert got == pytest.approx(numpy_corr(a, b), abs=1e-12)


def test_slugify(spark):
    df = spark.createDataFrame([("  Hello, World! ",), ("é_ü--9",), ("--",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(expr.slugify("x")).collect()] == ["hello_world", "é_ü_9", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("n,rate,new", [(100, 100.0, 80.0), (50, 100.0, 33.0), (7, 10.0, 25.0), (1, 10.0, 100.0)])
def test_resample(spark, n, rate, new):
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    got = one(spark, s=[float(v) for v in x]).select(expr.resample_linear(F.col("s").cast("array<float>"), F.lit(rate), new)).first()[0]
    m = max(1, round(n / rate * new))
    t = n / rate
    want = np.interp(np.arange(m) * t / m, np.arange(n) * t / n, x)
    assert np.allclose(got, want, atol=1e-5)


def test_unit_interval(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(expr.unit_interval("x")).collect()] == [0.0, 0.5, 1.0, None]


def test_notch_and_band_power():
    t = np.arange(200) / 100
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 20 * t)
    bands = spectral.bands_at(100.0)
    assert [b[0] for b in bands] == ["delta", "theta", "alpha", "beta", "gamma"]
    p = dict(zip([b[0] for b in bands], spectral.powers(x, 100.0, bands)))
    q = dict(zip([b[0] for b in bands], spectral.powers(preprocess.without_bands(x, 100.0, (20.0,), 2.0).astype(float), 100.0, bands)))
    assert q["beta"] < 1e-6 * p["beta"] and q["alpha"] == pytest.approx(p["alpha"], rel=1e-4)
    assert spectral.bands_at(5.0) == [("broadband", 0.0, 2.5)]
    assert [b[0] for b in spectral.bands_at(80.0)] == ["delta", "theta", "alpha", "beta"]


def test_phase_ranges(spark):
    windows = epochs.Windows(1.0, 1.0, 0.5, 1.0, None, epochs.Baseline(-1.0, 0.0))
    ev = spark.createDataFrame([("e", 5.0, 2.0), ("z", 0.2, 0.0), ("end", 29.8, 1.0)], "event_id string, onset_seconds double, duration_seconds double")
    got = epochs.sample_range(epochs.phase_requests(ev, windows), F.lit(100.0), F.lit(3000)).collect()
    at = {(r.event_id, r.phase): r for r in got}
    assert [(at["e", p].start_sample, at["e", p].end_sample) for p in (*epochs.PHASES, "baseline")] == [(400, 500), (500, 600), (600, 650), (650, 700), (700, 800), (400, 500)]
    assert at["z", "pre_event"].clipped and "clipped to the recording bounds" in at["z", "pre_event"].warning
    assert at["z", "sustained"].derived_samples == 0
    assert "exceeded the recording duration" in at["end", "post_event"].warning
    assert all(0 <= r.start_sample <= r.end_sample <= 3000 for r in got)


def test_align_and_reference_keep_nan(spark):
    rows = [("e", "onset", 100.0, k, c, [1.0 * k, 2.0, float("nan")]) for k, c in enumerate(("A", "B"))]
    df = spark.createDataFrame(rows, "event_id string, phase string, sampling_rate_hz double, channel_idx int, channel string, samples array<float>")
    out = preprocess.preprocess(df, preprocess.Branch("b", align_channels=("B", "X"), rereference="average"), ["event_id"]).orderBy("channel_idx").collect()
    assert [r.channel for r in out] == ["B", "X"]
    assert out[0].samples[:2] == [0.0, 0.0] and np.isnan(out[0].samples[2]) and np.isnan(out[1].samples).all()


def test_branch_checks():
    assert preprocess.Branch(" ").check() and preprocess.Branch("a", baseline="x").check() and preprocess.Branch("a", rereference="channels").check()
    assert not preprocess.Branch("a", notch_hz=(60.0,)).check()


def test_channel_faults(spark):
    df = spark.createDataFrame([([],), (["a", "a"],), (["a b", ""],), (["a", "b"],)], "c array<string>")
    assert [len(r[0]) for r in df.select(checks.channel_faults(F.col("c"))).collect()] == [1, 1, 2, 0]


def test_model_inputs(spark):
    df = spark.createDataFrame([("p", ["fp1", "T3", "C3"], [[1.0, 2.0], [3.0, float("nan")], [5.0, 6.0]])], "id string, channels array<string>, data array<array<float>>")
    m = backbone.Model("m", lambda x: x.mean(axis=1), montage=("FP1", "CZ", "C3"), length=4)
    r = backbone.prepared(df, m).first()
    assert r.missing == ["CZ"] and len(r.data) == 3 and len(r.data[0]) == 4 and r.data[1] == [0.0] * 4
    x, status = backbone.embeddings(df, [m, backbone.Model("bad", lambda x: 1 / 0)], ["id"])
    assert [len(v.x) for v in x.collect()] == [3]
    assert sorted((s.model_id, s.status) for s in status.collect()) == [("bad", "failed"), ("m", "used")]


def test_sensor_positions(spark):
    df = spark.createDataFrame([("C3",), ("c4",), ("Cz",), ("T3",), ("FT10",), ("M2",), ("EKG",), ("C11",)], "c string")
    got = [r[0] for r in df.select(backbone.sensor_position(F.col("c"))).collect()]
    assert [tuple(g)[:2] if g else None for g in got] == [(-0.34, 0.0), (0.34, 0.0), (0.0, 0.0), (-0.74, 0.02), (0.88, 0.38), (0.96, -0.12), None, None]
    assert got[2].z == 1.0 and all(g.x**2 + g.y**2 + g.z**2 <= 1.0001 for g in got if g)
    names = ["Fp1", "O2", "EKG", "C3", "Pz", "T8"]
    layout = spark.createDataFrame([(names,), ([],)], "c array<string>").select(backbone.sensor_layout(F.col("c")).alias("l")).collect()
    p = np.array([[r.x, r.y, r.z] for r in layout[0].l])
    assert [r.idx for r in layout[0].l] == [0, 1, 3, 4, 5] and not layout[1].l
    assert np.allclose(p.mean(0), 0) and np.sqrt(3 * (p**2).sum(1).mean()) == pytest.approx(1)


def test_positioned_and_patched(spark):
    rows = [(["C3", "C4", "F3", "F4", "X1"], [[float(k)] * 5 for k in range(5)]), (["C3", "X"], [[1.0], [2.0]])]
    df = spark.createDataFrame(rows, "channels array<string>, data array<array<float>>")
    got = backbone.positioned(df).collect()
    assert got[0].status == "used" and got[0].excluded == ["X1"] and len(got[0].data) == 4
    assert got[1].status == "failed" and got[1].data is None
    cut = backbone.patched(df, 20, 4).first().data
    assert len(cut) == 5 and len(cut[0]) == 4 and len(cut[0][0]) == 5


def test_model_shapes(spark):
    names = ["FP1", "C3", "C4", "T3", "O2"]
    df = spark.createDataFrame([(names, [[float(k)] * 300 for k in range(5)])], "channels array<string>, data array<array<float>>")
    shape = lambda m: np.array(backbone.model_input(df, m).first().data).shape
    assert [shape(m) for m in ("biot", "eegpt", "cbramod", "brainomni")] == [(18, 2000), (58, 512), (5, 10, 200), (5, 300)]
    assert len(set(backbone.MONTAGE_58)) == 58 and "T7" in backbone.model_input(df, "eegpt").first().missing
    assert "T7" not in backbone.model_input(df, "eegpt", alias=True).first().missing
    with pytest.raises(KeyError):
        backbone.model_input(df, "none")


def test_bids(spark):
    df = spark.createDataFrame([("/d/sub-1/eeg/sub-1_task-x_eeg.edf",), ("/d/rec.edf",)], "p string")
    got = df.select(checks.bids_path(F.col("p")), checks.bids_sidecars(F.col("p"))).collect()
    assert [g[0] for g in got] == [True, False]
    assert got[0][1] == ["/d/sub-1/eeg/sub-1_task-x_eeg.json", "/d/sub-1/eeg/sub-1_task-x_channels.tsv", "/d/sub-1/eeg/sub-1_task-x_events.tsv"]


def test_branch_findings():
    codes = lambda b: [c for _, c, _, _ in checks.branch_findings(b)]
    assert codes(preprocess.Branch("raw_preserving", scale=2.0)) == ["preprocess.raw_branch_modified"]
    assert codes(preprocess.Branch("x", align_channels=("a", "a"))) == ["preprocess.align_duplicate"]
    assert codes(preprocess.Branch("x")) == []
