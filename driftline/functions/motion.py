"""Motion features, model inputs and outputs as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: standard gravity.
G = 9.80665
CHANNELS = ("a1", "a2", "av", "w1", "w2", "w_yaw", "a_excess", "a_horizontal", "w_total")
REFERENCE_AGE_MAX = 120.0


def norm3(v: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot3(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def levelling_rows(g: tuple[Column, Column, Column]):
    """Rows x, y, z of the rotation that levels the phone: z along gravity, y the phone's top in the horizontal plane.

    Where the top points along gravity, the phone's own x axis takes its part.
    """
    size = norm3(g)
    z = tuple(c / size for c in g)
    zero, one = F.lit(0.0), F.lit(1.0)
    top = tuple(a - z[1] * b for a, b in zip((zero, one, zero), z, strict=True))
    side = tuple(a - z[0] * b for a, b in zip((one, zero, zero), z, strict=True))
    flat = norm3(top) < 1e-3
    y = tuple(F.when(flat, a).otherwise(b) for a, b in zip(cross3(z, side), top, strict=True))
    length = norm3(y)
    y = tuple(c / length for c in y)
    return cross3(y, z), y, z


def feature_channels(acc, gyro, g) -> dict[str, Column]:
    """The nine channels of a sample: levelled acceleration and rotation, and three magnitudes, as floats."""
    x, y, z = levelling_rows(g)
    a1, a2, a3 = (dot3(r, acc) for r in (x, y, z))
    out = (a1, a2, a3 - G, *(dot3(r, gyro) for r in (x, y, z)), norm3(acc) - G, F.hypot(a1, a2), norm3(gyro))
    return {name: c.cast("float") for name, c in zip(CHANNELS, out, strict=True)}


def reference_scalars(speed: Column, age: Column, valid: Column) -> Column:
    """Reference speed, its age within bounds and its validity as an array of floats; zeros if invalid."""
    v = valid.cast("double")
    return F.array(speed * v, F.least(F.greatest(age, F.lit(0.0)), F.lit(REFERENCE_AGE_MAX)) * v, v).cast("array<float>")


def normalise(values: Column, mean: Column, std: Column) -> Column:
    """Arrays of channel values less their means over their deviations."""
    return F.zip_with(F.zip_with(values, mean, lambda a, b: a - b), std, lambda a, b: a / b)


def transpose(matrix: Column, width: int) -> Column:
    """Rows of a matrix as columns."""

    def column(i: int) -> Column:
        return F.transform(matrix, lambda row: row[i])

    return F.array(*[column(i) for i in range(width)])


def variance(log_variance: Column) -> Column:
    return F.exp(log_variance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence(var: Column) -> Column:
    return 1 / (1 + F.sqrt(F.greatest(var, F.lit(0.0))))


def fix_quality(accuracy: Column) -> Column:
    return F.greatest(F.least(1 - (accuracy - 3) / 25, F.lit(1.0)), F.lit(0.1))


def window_stats(values: Column) -> Column:
    """Mean, population deviation, mean absolute difference, 5th and 95th percentile of an array of numbers, and the
    mean size of its Fourier components, without the constant one, in four bands from low to high."""
    n = F.size(values)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    mean = total(values) / n
    squares = total(F.transform(values, lambda v: (v - mean) * (v - mean)))
    steps = F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda a, b: F.abs(a - b))
    ordered = F.array_sort(values)

    def percentile(q: float) -> Column:
        place = (n - 1) * q
        low = F.floor(place).cast("int")
        at = lambda i: F.get(ordered, i)
        return at(low) + (at(F.least(low + 1, n - 1)) - at(low)) * (place - low)

    half = F.floor(n / 2).cast("int")
    turn = lambda k, i: 2 * math.pi * k * i / n

    def component(k: Column) -> Column:
        along, across = (total(F.transform(values, lambda v, i: (v - mean) * f(turn(k, i)))) for f in (F.cos, F.sin))
        return F.hypot(along, across)

    spectrum = F.transform(F.when(half >= 1, F.sequence(F.lit(1), half)).otherwise(F.array().cast("array<int>")), component)

    def band(j: int) -> Column:
        # the first bands have one component more where they do not divide evenly
        width, more = F.floor(half / 4).cast("int"), half % 4
        size = width + F.when(more > j, 1).otherwise(0)
        part = F.slice(spectrum, j * width + F.least(F.lit(j), more) + 1, size)
        return total(part) / F.nullif(size, F.lit(0))

    return F.struct(
        *[band(j).alias(f"band{j + 1}") for j in range(4)],
        mean.alias("mean"), F.sqrt(squares / n).alias("std"),
        F.when(n > 1, total(steps) / (n - 1)).alias("mean_abs_diff"), percentile(0.05).alias("p05"), percentile(0.95).alias("p95"),
    )
