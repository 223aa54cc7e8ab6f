"""The jobs: two runs over growing input, reruns, odd rows, command lines."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from jobs import common, epoch_plan, language_profiles

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"


def events(spark, rows):
    from datetime import datetime, timedelta

    made = [(i, u, None if at is None else datetime(2024, 1, 1) + timedelta(seconds=at), kind, value) for i, u, at, kind, value in rows]
    return spark.createDataFrame(made, EVENTS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


CONFIG = common.packaged("epoch_plan.json")


def test_epoch_plan_takes_only_what_is_new(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    first = [(1, 7, 100.0, "click", 5.0), (1, 7, 100.0, "click", 5.0), (2, 7, 10.0, " view ", 0.0), (3, 8, 50.0, "", 1.0), (4, 8, 60.0, "view", -1.0), (None, 8, 60.0, "view", 1.0), (5, 8, None, "view", float("nan"))]
    events(spark, first).write.parquet(f"{source}/day=1")
    assert not epoch_plan.result(spark, out).count()
    flat = dict(CONFIG)
    got = epoch_plan.run(spark, f"{source}/*", out, mark, flat)
    assert got == {"batches": 1, "read": 7, "planned": 12, "rejected": 4}
    before = rows_of(epoch_plan.result(spark, out))
    assert {(r[0], r[2]) for r in before} == {("1", "click"), ("2", "view")} and len(before) == 12
    assert epoch_plan.run(spark, f"{source}/*", out, mark, flat)["batches"] == 0
    assert rows_of(epoch_plan.result(spark, out)) == before
    # new files: a new event, an event that came before, two versions of one
    events(spark, [(9, 7, 500.0, "click", 5.0), (1, 7, 900.0, "click", 5.0), (6, 9, 70.0, "view", 1.0), (6, 9, 30.0, "view", 1.0)]).write.parquet(f"{source}/day=2")
    got = epoch_plan.run(spark, f"{source}/*", out, mark, flat)
    assert got == {"batches": 1, "read": 4, "planned": 12, "rejected": 2}
    now = rows_of(epoch_plan.result(spark, out))
    assert set(before) < set(now) and len(now) == 24
    starts = {r[0]: r[4] for r in now if r[3] == "onset"}
    assert starts == {"1": 10000, "2": 1000, "9": 50000, "6": 3000}
    told = {(r["event_id"], r["message"]) for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert told == {
        ("3", "no target_label"), ("4", "duration_seconds is negative"), ("", "no event_id"), ("5", "onset_seconds is no number; duration_seconds is no number"),
        ("1", "event came in an earlier batch"), ("6", "event id comes more than once"),
    }
    assert sorted(os.listdir(f"{out}/plan"))[-6:] == [f"phase={p}" for p in ("baseline", "offset", "onset", "post_event", "pre_event", "sustained")]


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    events(spark, [(i, i % 3, 10.0 * i, "click", 1.0) for i in range(20)]).write.parquet(source)
    epoch_plan.run(spark, source, out, mark, CONFIG)
    before = rows_of(epoch_plan.result(spark, out))
    for name in [n for n in os.listdir(f"{mark}/commits") if not n.startswith(".")]:
        os.rename(f"{mark}/commits/{name}", f"{tmp_path}/{name}")  # as if it had stopped before it committed
        if os.path.exists(f"{mark}/commits/.{name}.crc"):
            os.rename(f"{mark}/commits/.{name}.crc", f"{tmp_path}/.{name}.crc")
    assert epoch_plan.run(spark, source, out, mark, CONFIG)["batches"] == 1
    assert rows_of(epoch_plan.result(spark, out)) == before


def test_epoch_plan_in_several_batches_and_settings(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    events(spark, [(i, i % 3, 10.0 * i, "click", 1.0) for i in range(20)]).repartition(4).write.parquet(source)
    conf = dict(spark.sparkContext.getConf().getAll())
    got = epoch_plan.run(spark, source, out, mark, CONFIG | {"max_files_per_batch": 2})
    assert got["batches"] >= 2 and got["planned"] == 120 and dict(spark.sparkContext.getConf().getAll()) == conf
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"
    with pytest.raises(Exception, match="non-negative"):
        epoch_plan.run(spark, source, f"{out}2", f"{mark}2", CONFIG | {"windows": {"pre_event": -1.0}})


def test_language_profiles(spark, tmp_path):
    docs = [("aab " * 5, "x", "s1"), ("aab " * 9, "x", "s2"), ("aab " * 3, "x", "s2"), ("bcc " * 4, "y", "s1"), ("ccb bcc", "y", "s2"), ("BCC", "y", None), (None, "y", "s1"), ("123", "x", "s1"), ("aa", " ", "s1")]
    spark.createDataFrame([(*r, "clash") for r in docs], "text string, lang string, source string, label string").write.parquet(f"{tmp_path}/docs")
    config = common.packaged("language_profiles.json")
    for _ in range(2):
        counts = language_profiles.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", config)
        got = {(r["lang"], r["source"]): r for r in language_profiles.result(spark, f"{tmp_path}/out").collect()}
        assert counts == {"read": 9, "profiles": 6 * 26, "report": 6}
    assert set(got) == {("x", "s1"), ("x", "s2"), ("y", "s1"), ("y", "s2"), ("y", "unknown"), ("unknown", "s1")}
    assert got["x", "s2"]["n_documents"] == 2 and got["x", "s2"]["n_of_language"] == 3
    assert got["x", "s1"]["within"] == 1.0 and got["x", "s1"]["held_out_margin"] > 0 and got["unknown", "s1"]["held_out_margin"] is None
    shares = {r["letter"]: r["share"] for r in spark.read.parquet(f"{tmp_path}/out/profiles").filter("lang = 'y' AND source = 's1'").collect()}
    assert shares["b"] == pytest.approx(1 / 3, abs=1e-6) and shares["c"] == pytest.approx(2 / 3, abs=1e-6) and sum(shares.values()) == pytest.approx(1, abs=1e-5)


def test_language_profiles_count_letters_in_one_pass(spark, tmp_path):
    """10 MB of text; made again for each letter and filter this took over a minute."""
    texts = [("Abc é ÉaZ 1" + chr(97 + i % 26)) * 3000 for i in range(300)]
    texts += ["b" * (1 << 20) + "C" * 5, "é", "É A", ""]
    spark.createDataFrame([(t, "x", "s") for t in texts], "text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/docs")
    config = common.packaged("language_profiles.json") | {"letters": "abcdefghijklmnopqrstuvwxyzéQ"}
    began = time.monotonic()
    rows = language_profiles.vectors(spark.read.parquet(f"{tmp_path}/docs"), config).collect()
    assert time.monotonic() - began < 20
    low = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    counts = [[t.count(c) for c in config["letters"]] for t in low]
    assert sorted(list(r["x"]) for r in rows) == sorted([n / sum(c) for n in c] for c in counts if sum(c))


def test_language_profiles_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "text string, lang string, source string").write.parquet(f"{tmp_path}/docs")
    assert language_profiles.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", common.packaged("language_profiles.json")) == {"read": 0, "profiles": 0, "report": 0}
    assert language_profiles.result(spark, f"{tmp_path}/out").count() == 0


def test_command_line(spark, tmp_path):
    events(spark, [(1, 7, 100.0, "click", 5.0)]).write.parquet(f"{tmp_path}/in")
    with open(f"{tmp_path}/c.json", "w") as f:
        json.dump(CONFIG | {"n_samples": 10100}, f)
    command = [sys.executable, "-m", "jobs.epoch_plan", "--source", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/c.json"]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1]) == {"batches": 1, "planned": 6, "read": 1, "rejected": 0}
    assert "1 rows read" in done.stderr
    plan = epoch_plan.result(spark, f"{tmp_path}/out").filter(F.col("phase") == "post_event").first()
    assert plan["end_sample"] == 10100 and plan["clipped"]
