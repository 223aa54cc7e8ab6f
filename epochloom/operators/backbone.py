"""Model evidence: input preparation, pluggable embedding, consensus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions
from ..functions.expr import let, resample_inclusive

#: The montage of eighteen older names.
MONTAGE_18 = (
    "FP1", "FP2", "F7", "F3", "FZ", "F4", "F8",
    "T3", "C3", "CZ", "C4", "T4",
    "T5", "P3", "P4", "T6", "O1", "O2",
)
#: The montage of fifty-eight newer names.
MONTAGE_58 = (
    "FP1", "FPZ", "FP2",
    "AF3", "AF4",
    "F7", "F5", "F3", "F1", "FZ", "F2", "F4", "F6", "F8",
    "FT7", "FC5", "FC3", "FC1", "FCZ", "FC2", "FC4", "FC6", "FT8",
    "T7", "C5", "C3", "C1", "CZ", "C2", "C4", "C6", "T8",
    "TP7", "CP5", "CP3", "CP1", "CPZ", "CP2", "CP4", "CP6", "TP8",
    "P7", "P5", "P3", "P1", "PZ", "P2", "P4", "P6", "P8",
    "PO7", "PO3", "POZ", "PO4", "PO8",
    "O1", "OZ", "O2",
)
#: Older electrode names and the newer ones.
ALIASES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8", "M1": "A1", "M2": "A2"}
#: Height (front to back) of an electrode's row.
ROW_HEIGHT = {
    "FP": 0.92, "AF": 0.78, "F": 0.58, "FT": 0.38, "FC": 0.32, "T": 0.02, "C": 0.0,
    "TP": -0.34, "CP": -0.30, "P": -0.56, "PO": -0.78, "O": -0.92, "A": -0.10,
}
#: Distance from the middle by an electrode's number.
LATERAL = {0: 0.0, 1: 0.18, 2: 0.18, 3: 0.34, 4: 0.34, 5: 0.50, 6: 0.50, 7: 0.74, 8: 0.74, 9: 0.88, 10: 0.88}
#: Rows whose height above the plane is lowered to 0.8 of it; place of the ear electrodes.
LOWERED = ("P", "PO", "O", "A", "TP")
LOWERING = 0.8
#: Farthest from the middle that a flat position counts.
RIM = 0.995
EARS = {"A1": (-0.96, -0.12, 0.0), "A2": (0.96, -0.12, 0.0)}


@dataclass(frozen=True)
class Model:
    """A model by its id: how its input is made, and a function from an array
    [channels, samples] to a vector or, if ``batched``, from an array [rows,
    channels, samples] to one vector for each row. Functions run in Arrow
    batches on the executors and load what they need there, once per worker.

    input: the id of a known model whose input this one takes (``model_input``);
    of "brainomni", embed gets (data, positions [.., channels, 6]) and data of
    "cbramod" has patches as its last but one axis. Otherwise montage and
    length say what is asked for."""

    model_id: str
    embed: Callable[..., np.ndarray]
    montage: tuple[str, ...] = ()
    length: int | None = None
    alias: bool = False
    batched: bool = False
    input: str = ""


def normal_name(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def canonical_name(c: Column) -> Column:
    """Older electrode names as the newer ones."""
    n = normal_name(c)
    out = n
    for old, new in ALIASES.items():
        out = F.when(n == old, new).otherwise(out)
    return out


def prepared(matrix: DataFrame, model: Model) -> DataFrame:
    """``matrix`` (channels, data) with model_id, data as the model takes it and
    missing channels; absent channels are zeros, NaN is 0."""
    names = F.transform("channels", canonical_name if model.alias else normal_name)
    data = F.transform("data", lambda s: F.transform(s, lambda v: F.nanvl(v, F.lit(0.0).cast("float"))))
    out = matrix.withColumn("_names", names).withColumn("data", data).withColumn("model_id", F.lit(model.model_id))
    if model.montage:
        wanted = F.array(*map(F.lit, model.montage))
        zeros = F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(F.size(F.get("data", F.lit(0))), F.lit(0)))
        pick = lambda n: F.when(F.array_contains("_names", n), F.get("data", (F.array_position("_names", n) - 1).cast("int"))).otherwise(zeros)
        out = out.withColumn("data", F.transform(wanted, pick)).withColumn("missing", F.array_except(wanted, F.col("_names"))).withColumn("channels", wanted)
    else:
        out = out.withColumn("missing", F.array().cast("array<string>"))
    if model.length:
        out = out.withColumn("data", F.transform("data", lambda s: resample_inclusive(s, model.length)))
    return out.drop("_names")


def patches(samples: Column, n: int, width: int) -> Column:
    """A series as ``n`` patches of ``width`` samples."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(samples, k * width + 1, width))


def sensor_position(name: Column) -> Column:
    """struct<x, y, z> of a standard electrode on the unit sphere, or null for
    any other name: letters give the row, an odd number left, an even one right."""
    n = canonical_name(name)
    shape = "^([A-Z]+?)(Z|[0-9]{1,2})$"
    row, place = F.regexp_extract(n, shape, 1), F.regexp_extract(n, shape, 2)
    number = place.try_cast("int")
    y = F.try_element_at(F.create_map(*[F.lit(v) for p in ROW_HEIGHT.items() for v in p]), row)
    reach = F.try_element_at(F.create_map(*[F.lit(v) for p in LATERAL.items() for v in p]), number)
    x = F.when(place == "Z", F.lit(0.0)).when(number % 2 == 1, -reach).otherwise(reach)
    flat = F.least(F.lit(RIM * RIM), x * x + y * y)
    z = F.sqrt(1.0 - flat) * F.when(row.isin(*LOWERED), LOWERING).otherwise(1.0)
    out = F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    for ear, at in EARS.items():
        out = F.when(n == ear, F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", at)])).otherwise(out)
    return out


def sensor_layout(channels: Column) -> Column:
    """array<struct<channel, idx, x, y, z>> of the channels with a position:
    centred, and divided by the root of three times the mean squared distance."""
    rows = F.filter(F.transform(channels, lambda c, i: F.struct(c.alias("channel"), i.alias("idx"), sensor_position(c).alias("p"))), lambda r: r["p"].isNotNull())

    def centred(held: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])
        total = F.aggregate(held, zero, lambda s, r: F.struct(*[(s[k] + r["p"][k]).alias(k) for k in "xyz"]))
        return let(total, lambda t: F.transform(held, lambda r: F.struct(r["channel"].alias("channel"), r["idx"].alias("idx"), *[(r["p"][k] - F.try_divide(t[k], F.size(held))).alias(k) for k in "xyz"])))

    def scaled(held: Column) -> Column:
        squares = F.aggregate(held, F.lit(0.0), lambda s, r: s + r["x"] * r["x"] + r["y"] * r["y"] + r["z"] * r["z"])
        size = F.sqrt(3.0 * F.try_divide(squares, F.size(held)))
        return let(size, lambda n: F.transform(held, lambda r: F.struct(r["channel"].alias("channel"), r["idx"].alias("idx"), *[F.when(n > 0, r[k] / n).otherwise(r[k]).alias(k) for k in "xyz"])))

    return let(let(rows, centred), scaled)


#: Fewest channels with a position that a model of sensor positions takes.
LEAST_POSITIONED = 4


def positioned(matrix: DataFrame) -> DataFrame:
    """``matrix`` on its channels with a position, with ``layout``; rows with
    too few of them have status failed and no data."""
    out = matrix.withColumn("layout", sensor_layout(F.col("channels")))
    good = F.size("layout") >= LEAST_POSITIONED
    kept = F.transform("layout", lambda r: F.get("data", r["idx"]))
    out = out.withColumn("excluded", F.array_except("channels", F.transform("layout", lambda r: r["channel"])))
    out = out.withColumn("data", F.when(good, kept)).withColumn("channels", F.transform("layout", lambda r: r["channel"]))
    return out.withColumn("status", F.when(good, "used").otherwise("failed"))


def patched(matrix: DataFrame, length: int = 2000, n: int = 10) -> DataFrame:
    """Channels resampled to ``length`` and cut into ``n`` patches."""
    return matrix.withColumn("data", F.transform("data", lambda s: patches(resample_inclusive(s, length), n, length // n)))


def model_input(matrix: DataFrame, model_id: str, alias: bool = False) -> DataFrame:
    """``matrix`` as one of the known models takes it: biot 18 x 2000, eegpt
    58 x 512, cbramod C x 10 x 200, brainomni the positioned channels as they
    are, with their layout."""
    as_is = lambda x: x
    if model_id == "biot":
        return prepared(matrix, Model(model_id, as_is, MONTAGE_18, 2000, alias))
    if model_id == "eegpt":
        return prepared(matrix, Model(model_id, as_is, MONTAGE_58, 512, alias))
    if model_id == "cbramod":
        return patched(matrix).withColumn("model_id", F.lit(model_id))
    if model_id == "brainomni":
        return positioned(matrix).withColumn("model_id", F.lit(model_id))
    raise KeyError(f"no input is known for model {model_id!r}")


def taken(matrix: DataFrame, model: Model) -> DataFrame:
    """``matrix`` with data as the model takes it (null if it can't be made),
    its channels, notes on what is missing, and positions for a model that
    wants them."""
    if not model.input:
        out = prepared(matrix, model)
        return out.withColumn("positions", F.lit(None).cast("array<array<double>>")).withColumn("status", F.lit("used")).withColumn("excluded", F.array().cast("array<string>"))
    out = model_input(matrix, model.input, model.alias).withColumn("model_id", F.lit(model.model_id))
    empty = F.array().cast("array<string>")
    has = set(out.columns)
    zero = F.lit(0.0)
    positions = F.transform("layout", lambda r: F.array(r["x"], r["y"], r["z"], zero, zero, zero)) if "layout" in has else F.lit(None).cast("array<array<double>>")
    for name, value in (("positions", positions), ("missing", empty), ("excluded", empty), ("status", F.lit("used"))):
        if name not in has:
            out = out.withColumn(name, value)
    return out.drop("layout")


def pooled(x) -> np.ndarray:
    """One vector of a row's embedding: the mean over all axes (channels,
    patches, tokens) but the last."""
    x = np.asarray(x, np.float64)
    return x.reshape(-1, x.shape[-1]).mean(0) if x.ndim > 1 else np.atleast_1d(x)


def _embedder(model: Model, keys: list[str]):
    def called(rows: list[np.ndarray], places: list[np.ndarray | None]) -> list[np.ndarray]:
        """One vector for each row, rows of one shape together."""
        with_places = places[0] is not None
        if model.batched:
            return list(map(pooled, model.embed(np.stack(rows), np.stack(places)) if with_places else model.embed(np.stack(rows))))
        return [pooled(model.embed(x, p) if with_places else model.embed(x)) for x, p in zip(rows, places)]

    def array(cell) -> np.ndarray:
        return np.stack([array(c) for c in cell]) if len(cell) and isinstance(cell[0], (np.ndarray, list)) else np.asarray(cell, np.float32)

    def run(batches):
        for b in batches:
            found: dict[int, tuple[np.ndarray | None, str | None]] = {}
            same: dict[tuple, list[int]] = {}
            data: dict[int, np.ndarray] = {}
            where: dict[int, np.ndarray | None] = {}
            for i, (cell, place) in enumerate(zip(b["data"], b["positions"])):
                if cell is None:
                    found[i] = None, "too few channels with a position"
                    continue
                data[i], where[i] = array(cell), None if place is None else array(place)
                same.setdefault((data[i].shape, place is None), []).append(i)
            for rows in same.values():
                try:
                    found |= {i: (x, None) for i, x in zip(rows, called([data[i] for i in rows], [where[i] for i in rows]), strict=True)}
                except Exception:  # one row may be at fault: each by itself
                    for i in rows:
                        try:
                            found[i] = called([data[i]], [where[i]])[0], None
                        except Exception as fault:  # a row's fault is evidence, kept in the status table
                            found[i] = None, f"{type(fault).__name__}: {fault}"
            out = b[keys].copy()
            out["x"], out["message"] = [found[i][0] for i in range(len(b))], [found[i][1] for i in range(len(b))]
            yield out

    return run


def embedded(matrix: DataFrame, models: list[Model], keys: list[str]) -> DataFrame:
    """keys, model_id, x, message: a row for each row and model, x null where
    the model failed on it (message says why), not a failed task."""
    done = None
    for model in models:
        rows = taken(matrix, model).select(*keys, "model_id", "data", "positions")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("data", "positions")) + ", x array<double>, message string"
        got = rows.mapInPandas(_embedder(model, [*keys, "model_id"]), schema)
        done = got if done is None else done.unionByName(got)
    return done


def embeddings(matrix: DataFrame, models: list[Model], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, model_id, x; keys, model_id, status, message)."""
    done = embedded(matrix, models, keys)
    x = done.filter("x IS NOT NULL").select(*keys, "model_id", "x")
    return x, done.select(*keys, "model_id", F.when(F.col("x").isNull(), "failed").otherwise("used").alias("status"), "message")


def consensus(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_used, n_positive, n_not_positive, mean_margin, margins, consensus.
    evidence: keys, model, status, margin."""
    used = F.col("status") == "used"
    out = evidence.groupBy(*keys).agg(
        F.count_if(used).alias("n_used"), F.count_if(used & F.coalesce(F.col("margin") > 0, F.lit(False))).alias("n_positive"), F.count_if(used & F.coalesce(F.col("margin") <= 0, F.lit(False))).alias("n_not_positive"),
        F.avg(F.when(used, F.col("margin"))).alias("mean_margin"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "margin")))).alias("margins"),
    )
    return out.withColumn("consensus", decisions.consensus(F.col("n_used"), F.col("n_positive")))
