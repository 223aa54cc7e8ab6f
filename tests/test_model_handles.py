"""Models that workers make: small tasks, one load a process, faults known
before a run, files fetched from a store that isn't a local folder."""

import os
import uuid

import numpy as np
import pytest
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from epochloom.operators import backbone
from epochloom.plans import models
from epochloom.plans.models import Adapter, ModelLoadError, Registry


def makers():
    """Functions that go to workers by value, as a user's own would."""

    def make_sum(root, variant, device):
        """Weights are mapped; each load leaves a mark beside them."""
        weights = np.memmap(f"{root}/{variant}.bin", np.float32, "r")
        open(f"{root}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: np.stack((x.reshape(len(x), -1).sum(axis=1), np.full(len(x), weights[-1])), axis=1)

    def make_fault(root, variant, device):
        raise MemoryError(f"no room for {variant}")

    return make_sum, make_fault


make_sum, make_fault = makers()


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    with open(folder / "base.bin", "wb") as f:  # 200 MB, nearly all of it a hole
        f.truncate((200 << 20) - 4)
        f.seek(0, 2)
        f.write(np.float32(7).tobytes())
    return str(tmp_path)


def rows(spark, n):
    return spark.range(n).repartition(12).select("id", F.array(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))).alias("data"), F.lit(100.0).alias("rate"), F.array(F.lit("c")).alias("channels"))


def test_workers_load_once(spark, root):
    adapter = Adapter("big", variants={"base": ("base.bin",)}, make=make_sum)
    model = adapter.load(spark, root)
    assert len(cloudpickle.dumps(model.embed)) < 100_000
    for _ in range(2):
        x, status = backbone.embeddings(rows(spark, 60), [model], ["id"])
        assert {r["id"]: r["x"] for r in x.collect()} == {i: [i + 1.0, 7.0] for i in range(60)}
    loads = [f.split("-")[1] for f in os.listdir(f"{root}/big") if f.startswith("load-")]
    assert loads and len(loads) == len(set(loads)), "a process made the model twice"
    assert str(os.getpid()) not in loads


def test_changed_files_are_another_model(spark, root):
    adapter = Adapter("big", variants={"base": ("base.bin",)}, make=make_sum)
    first = adapter.load(spark, root)
    os.utime(f"{root}/big/base.bin", (1, 1))
    assert adapter.load(spark, root).embed != first.embed


def test_faults_are_known_before_the_run(spark, root):
    for make, why in ((make_fault, "no room for base"), ("nowhere:make", "nowhere")):
        with pytest.raises(ModelLoadError, match=why):
            Registry((Adapter("big", variants={"base": ("base.bin",)}, make=make),)).load(spark, root, "big")


def test_files_come_from_a_store(monkeypatch, root):
    """Where the folder can't be opened as it is, its files are fetched once."""
    handle = models.Handle("big", make_sum, f"{root}/big", ("base.bin",), "base", "cpu", "", "s1")
    monkeypatch.setattr(models, "opened", lambda p: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), p.lstrip("/")))
    place = handle.folder()
    assert place != f"{root}/big" and os.path.getsize(f"{place}/base.bin") == 200 << 20 and handle.folder() == place
    assert handle(np.ones((2, 1, 3)))[:, 0].tolist() == [3.0, 3.0]
