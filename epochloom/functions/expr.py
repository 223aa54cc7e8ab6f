"""Column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value made once: inside a lambda an expression is
    evaluated again for every element, a lambda's variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or(x: ColumnLike, *others: ColumnLike) -> Column:
    """Trimmed text; a blank one counts as absent and the next one is taken."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in (x, *others)], F.lit(""))


def slugify(x: ColumnLike, default: str = "unknown") -> Column:
    """Lower-case letters and digits (of any script) joined by underscores."""
    plain = F.regexp_replace(F.lower(F.trim(_col(x))), r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^_+|_+$", ""), F.lit("")), F.lit(default))


def nan_null(x: ColumnLike) -> Column:
    """NaN as null, so that aggregates skip it."""
    c = _col(x)
    return F.when(~F.isnan(c), c)


def null_nan(x: ColumnLike) -> Column:
    """An array with NaN for null: NaN that went through pandas comes back as null."""
    return F.transform(_col(x), lambda v: F.coalesce(v, F.lit(float("nan")).cast("float")))


def nan_avg(x: ColumnLike) -> Column:
    return F.avg(nan_null(x))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def lost(x: ColumnLike) -> Column:
    """array<int>: 0-based positions of a vector that are NaN or null."""
    c = _col(x)
    return F.filter(F.transform(c, lambda v, i: F.when(v.isNull() | F.isnan(v), i)), lambda i: i.isNotNull())


def centred_unit(x: ColumnLike, without: Column | None = None) -> Column:
    """A vector minus its mean, divided by its norm; zeros if the norm is 0.
    Positions ``without`` (0-based) have no part in it and are 0."""
    v = F.transform(_col(x), lambda e: e.cast("double"))
    if without is not None:
        v = let(without, lambda out: F.transform(v, lambda e, i: F.when(~F.array_contains(out, i), e)))

    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, e: s + e * e))
        return let(norm, lambda n: F.transform(d, lambda e: F.when(n > 0, e / n).otherwise(F.lit(0.0))))

    def centred(w: Column) -> Column:
        if without is None:
            return let(array_sum(w) / F.size(w), lambda m: let(F.transform(w, lambda e: e - m), scaled))
        held = F.filter(w, lambda e: e.isNotNull())
        mean = let(held, lambda h: F.try_divide(array_sum(h), F.size(h)))
        return let(mean, lambda m: let(F.transform(w, lambda e: F.coalesce(e - m, F.lit(0.0))), scaled))

    return F.when(F.size(_col(x)) > 0, let(v, centred)).otherwise(F.transform(_col(x), lambda e: e.cast("double")))


def safe_corr(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson correlation over the positions where neither side is NaN or
    null; 0 with fewer than two of them or without variance."""
    both = F.filter(
        F.zip_with(_col(a), _col(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]),
    )
    zero = F.lit(0.0)

    def score(pairs: Column) -> Column:
        sums = F.aggregate(pairs, F.struct(zero.alias("x"), zero.alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
        means = F.transform(F.array(sums), lambda s: F.struct((s["x"] / F.size(pairs)).alias("x"), (s["y"] / F.size(pairs)).alias("y")))

        def products(m: Column) -> Column:
            return F.aggregate(
                pairs,
                F.struct(zero.alias("xy"), zero.alias("xx"), zero.alias("yy")),
                lambda t, p: F.struct(
                    (t["xy"] + (p["x"] - m["x"]) * (p["y"] - m["y"])).alias("xy"), (t["xx"] + (p["x"] - m["x"]) * (p["x"] - m["x"])).alias("xx"), (t["yy"] + (p["y"] - m["y"]) * (p["y"] - m["y"])).alias("yy")
                ),
                lambda t: F.when((t["xx"] > 0) & (t["yy"] > 0), t["xy"] / (F.sqrt(t["xx"]) * F.sqrt(t["yy"]))).otherwise(zero),
            )

        return F.when(F.size(pairs) >= 2, F.element_at(F.transform(means, products), 1)).otherwise(zero)

    return let(both, score)


def unit_interval(x: ColumnLike) -> Column:
    """[-1, 1] to [0, 1], clipped; null stays null."""
    c = (_col(x) + 1.0) / 2.0
    return F.when(_col(x).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def scale(samples: ColumnLike, factor: float) -> Column:
    return F.transform(_col(samples), lambda v: (v * F.lit(float(factor))).cast("float"))


def _interpolated(samples: Column, at: Column) -> Column:
    """Linear interpolation at a fractional 0-based index, held at the end."""
    last = F.size(samples) - 1
    low = F.least(F.floor(at).cast("int"), last)
    high = F.least(low + 1, last)
    x, y = F.element_at(samples, low + 1), F.element_at(samples, high + 1)
    return (x + (y - x) * (at - low)).cast("float")


def resampled_length(n: Column, rate: Column, new_rate: float) -> Column:
    """Half-even rounding of the duration times the new rate, 1 at least."""
    return F.greatest(F.lit(1), F.bround(n / rate * F.lit(float(new_rate))).cast("int"))


def resample_linear(samples: ColumnLike, rate: ColumnLike, new_rate: float) -> Column:
    """Linear interpolation onto a grid whose end is left out; an empty or
    unchanged series stays as it is."""
    s, r = _col(samples), _col(rate).cast("double")
    n = F.size(s)
    m = resampled_length(n, r, new_rate)
    out = F.transform(F.sequence(F.lit(0), m - 1), lambda k: _interpolated(s, F.least(k * n / m, (n - 1).cast("double"))))
    return F.when((n > 0) & (r != F.lit(float(new_rate))), out).otherwise(s)


def resample_inclusive(samples: ColumnLike, length: int) -> Column:
    """Linear interpolation onto ``length`` points from the first sample to the last."""
    s = _col(samples)
    n = F.size(s)
    step = (n - 1) / F.lit(float(max(1, length - 1)))
    out = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: _interpolated(s, F.least(k * step, (n - 1).cast("double"))))
    return F.when(n > 0, out).otherwise(F.array_repeat(F.lit(0.0).cast("float"), length))


def band_mean(powers: ColumnLike) -> Column:
    c = _col(powers)
    return F.when(F.size(c) > 0, array_sum(c) / F.size(c)).otherwise(F.lit(0.0))


def severity(status: ColumnLike) -> Column:
    """Order of branch statuses, worst last."""
    c = _col(status)
    return F.when(c == "preserved", 0).when(c == "weakened", 1).when(c == "shifted", 2).otherwise(3)
