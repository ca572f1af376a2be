"""Ordered sequences and signals: grids, recurrences, spectra, angles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FLAGS = (("_-X", math.pi), ("_-Y", -math.pi / 2), ("_X", 0.0), ("_Y", math.pi / 2))


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> DataFrame:
    """(i, x): num evenly spaced points with both ends."""
    step = f"({stop!r}D - {start!r}D) / {max(num - 1, 1)}D"
    return spark.range(num).select(F.col("id").alias("i"), F.expr(f"{start!r}D + id * ({step})").alias("x"))


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """(i, x): points from start in steps, without stop."""
    num = max(0, math.ceil((stop - start) / step))
    return spark.range(num).select(F.col("id").alias("i"), F.expr(f"{start!r}D + id * {step!r}D").alias("x"))


def last_of_relaxation(df: DataFrame, series: str, order: list[str], noise: str, theta: float, mu: float, sigma: float, dt: float, start: float = 0.0) -> DataFrame:
    """Mean-reverting recurrence x += theta (mu - x) dt + sigma sqrt(dt) noise: its state after each series.

    A recurrence needs its series in order in one place; the fold is linear.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(noise).alias("_e"))))
    scale = sigma * math.sqrt(dt)
    end = F.aggregate(F.col("_rows"), F.lit(start), lambda x, r: x + F.lit(theta) * (F.lit(mu) - x) * F.lit(dt) + F.lit(scale) * r["_e"])
    return df.groupBy(series).agg(rows.alias("_rows"), F.count(F.lit(1)).alias("n")).select(series, "n", end.alias("x"))


def in_order(df: DataFrame, series: str, order: list[str], values: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """series, order and the columns out of a recurrence: start() is its first state, step(state, *values) gives the next state and a row.

    Rows are dealt by series, sorted, and read in batches with the state
    carried over, so a series of any length needs the memory of one batch.
    """
    import pandas as pd

    columns = [series, *order]
    schema = T.StructType([*df.select(*columns).schema.fields, *T.StructType.fromDDL(out).fields])
    names = schema.names[len(columns) :]

    def run(batches: Iterator):
        at, state = None, None
        for pdf in batches:
            rows = []
            for key, row in zip(pdf[series], zip(*(pdf[v] for v in values))):
                if state is None or key != at and not (pd.isna(key) and pd.isna(at)):
                    at, state = key, start()
                state, made = step(state, *row)
                rows.append(made)
            yield pd.concat([pdf[columns], pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    dealt = df.select(*dict.fromkeys([*columns, *values])).repartition(series).sortWithinPartitions(series, *order)
    return dealt.mapInPandas(run, schema)


def states(df: DataFrame, series: str, order: list[str], noise: str, theta: float, mu: float, sigma: float, dt: float, start: float = 0.0) -> DataFrame:
    """Every state x of the recurrence, one row per input row, in linear time."""
    scale = sigma * math.sqrt(dt)

    def step(x, e):
        x = x + theta * (mu - x) * dt + scale * e
        return x, (x,)

    return in_order(df, series, order, [noise], lambda: start, step, "x double")


def standardised(df: DataFrame, series: str, value: str) -> DataFrame:
    """value over its population standard deviation in the series."""
    spread = df.groupBy(series).agg(F.stddev_pop(value).alias("_s"))
    return df.join(spread, series).withColumn("standardised", F.when(F.col("_s") > 0, F.col(value) / F.col("_s"))).drop("_s")


def pink_weights(spark: SparkSession, n: int, dt: float, f_min: float, f_max: float) -> DataFrame:
    """(i, f, amplitude): amplitudes of a 1/f spectrum of n samples in a band, for a variance of one."""
    df = 1.0 / (n * dt)
    freqs = spark.range(n // 2 + 1).select(F.col("id").alias("i"), F.expr(f"id * {df!r}D").alias("f"))
    low, high = max(f_min, 0.0), min(f_max, (n // 2) * df)
    inside = (F.col("f") >= low) & (F.col("f") <= high) & (F.col("f") > 0)
    s = freqs.withColumn("s", F.when(inside, 1.0 / F.col("f")).otherwise(0.0))
    total = s.agg(F.sum("s").alias("total"))
    return s.select("i", "f", F.sqrt(F.col("s") / (F.lit(2.0) * total.scalar() * F.lit(df))).alias("amplitude"))


def _turn(*parts) -> float:
    """As uniform, on the driver or in a worker."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def pink_noise(n: int, dt: float, f_min: float, f_max: float, seed: int | str):
    """One trace of 1/f noise with unit variance (numpy)."""
    import numpy as np

    freqs = np.arange(n // 2 + 1) / (n * dt)
    band = (freqs >= max(f_min, 0.0)) & (freqs <= f_max) & (freqs > 0)
    if not band.any():
        raise ValueError("no frequency lies in the band")
    spectrum = np.zeros(len(freqs), dtype=complex)
    turns = np.array([_turn(seed, k) for k in np.flatnonzero(band)])
    spectrum[band] = np.exp(2j * np.pi * turns) / np.sqrt(freqs[band])
    trace = np.fft.irfft(spectrum, n=n)
    return trace / trace.std()


def pink_traces(spark: SparkSession, series: int, n: int, dt: float, f_min: float, f_max: float, seed: int = 0) -> DataFrame:
    """(series_id, i, value): independent traces, each made on an executor from its own seed."""

    def make(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"series_id": k, "i": range(n), "value": pink_noise(n, dt, f_min, f_max, f"{seed}:{k}")})

    return spark.range(series).mapInPandas(make, "series_id long, i long, value double")


def dft(df: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, k, re, im, magnitude) of the lower half of the spectrum of an array column, in JVM expressions."""
    n = F.size(signal)
    waves = df.select(key, F.col(signal).alias("_x"), F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))).alias("k"))
    turn = lambda i: F.lit(-2.0 * math.pi) * ((F.col("k") * i) % F.size("_x")) / F.size("_x")

    def part(wave) -> Column:
        return F.aggregate(F.transform("_x", lambda x, i: x.cast("double") * wave(turn(i))), F.lit(0.0), lambda a, b: a + b)

    got = waves.select(key, "k", part(F.cos).alias("re"), part(F.sin).alias("im"))
    return got.withColumn("magnitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def fft(df: DataFrame, key: str, signal: str) -> DataFrame:
    """As dft, by a fast transform in Arrow batches, for long signals."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("k int, re double, im double, magnitude double").fields])

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, x in zip(pdf[key], pdf[signal]):
                y = np.fft.rfft(np.asarray(x, dtype=float))
                yield pd.DataFrame({key: name, "k": np.arange(len(y), dtype=np.int32), "re": y.real, "im": y.imag, "magnitude": np.abs(y)})

    return df.select(key, signal).mapInPandas(run, schema)


def unwrapped(df: DataFrame, series: str, order: list[str], phase: str) -> DataFrame:
    """phase without jumps of more than pi along each series."""
    w = Window.partitionBy(series).orderBy(*order)
    step = F.col(phase) - F.lag(phase).over(w)
    turned = F.expr("_d + pi() - floor((_d + pi()) / (2 * pi())) * 2 * pi() - pi()")
    fixed = F.when(F.abs("_d") < math.pi, F.col("_d")).when((turned == -math.pi) & (F.col("_d") > 0), F.lit(math.pi)).otherwise(turned)
    extra = df.withColumn("_d", step).withColumn("_c", F.when(F.col("_d").isNull(), 0.0).otherwise(fixed - F.col("_d")))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return extra.withColumn("unwrapped", F.col(phase) + F.sum("_c").over(run)).drop("_d", "_c")


def strided(df: DataFrame, series: str, order: list[str], stride: int) -> DataFrame:
    """Every stride-th row of each series, from its first."""
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % stride == 0).drop("_i")


def difference(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def offsets(df: DataFrame, series: str, order: str, width: str) -> DataFrame:
    """start: where each item begins if the items of a series follow one another."""
    before = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)))


def flag_phase(item: str) -> tuple[Column, Column]:
    """The phase that a flag in the item's name stands for, and the name without it."""
    phase, plain = F.lit(0.0), F.col(item)
    for flag, value in reversed(FLAGS):
        has = F.col(item).contains(flag)
        phase = F.when(has, F.lit(value)).otherwise(phase)
        plain = F.when(has, F.replace(F.col(item), F.lit(flag), F.lit(""))).otherwise(plain)
    return phase, plain


def smooth_pulse(t: Column, start: Column, width: Column, ramp: Column, amplitude: Column) -> Column:
    """A pulse with raised-cosine edges of length ramp."""
    at = t - start
    edge = F.least(at, width - at)
    rising = F.lit(0.5) * (F.lit(1.0) - F.cos(F.lit(math.pi) * edge / ramp))
    return F.when((at < 0) | (at > width), 0.0).when((ramp <= 0) | (edge >= ramp), amplitude).otherwise(amplitude * rising)


def pulse_train(times: DataFrame, pulses: DataFrame, bucket: float) -> DataFrame:
    """(channel, i, t, signal): pulses (channel, start, width, t_ramp, amplitude, frequency, phase) summed at times (i, t).

    A range join: both sides are bucketed by time, a pulse into each bucket it
    touches, so a bucket meets its own pulses only.
    """
    spread = pulses.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("width")) / bucket))))
    cut = times.withColumn("bucket", F.floor(F.col("t") / bucket))
    inside = (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("start") + F.col("width"))
    wave = F.cos(F.lit(2 * math.pi) * F.col("frequency") * F.col("t") + F.col("phase"))
    part = smooth_pulse(F.col("t"), F.col("start"), F.col("width"), F.col("t_ramp"), F.col("amplitude")) * wave
    return cut.join(spread, "bucket").filter(inside).groupBy("channel", "i", "t").agg(F.sum(part).alias("signal"))


def sphere_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Polar and azimuthal angle of a vector."""
    return F.acos(z / F.sqrt(x * x + y * y + z * z)), F.atan2(y, x)


def gaussian_decay(t: Column, tau: Column) -> Column:
    return F.exp(-(t * t) / (tau * tau))


def exponential_decay(t: Column, tau: Column) -> Column:
    return F.exp(-t / tau)


def decay_slope(t: Column, gauss_tau: Column, exp_tau: Column) -> Column:
    """Derivative by t of the product of both decays."""
    both = gaussian_decay(t, gauss_tau) * exponential_decay(t, exp_tau)
    return both * (F.lit(-2.0) * t / (gauss_tau * gauss_tau) - F.lit(1.0) / exp_tau)


def coherence(df: DataFrame, series: str, order: list[str], weight: str, angle: str, dt: float, rate: float, tau: float) -> DataFrame:
    """What a two-level state keeps of its coherence while its phase spreads and its surroundings forget.

    weight: the state's off-diagonal magnitude; angle: the phase at which it
    dephases. Each row adds dt * rate * 2 * weight at that angle to a vector
    (re, im). The path walked is that vector's length plus the forgotten part.
    Of a longer path, the share that slope() names is forgotten: it leaves the
    vector along its own direction, and a vector shorter than that is lost
    whole. purity is the Gaussian decay of the path.
    """

    def slope(x: float) -> float:  # of exp(-x**2) * (1 - exp(-x / tau))
        keep, memory = math.exp(-x * x), math.exp(-x / tau)
        return keep * (memory / tau - 2 * x * (1 - memory))

    def step(state, w, at):
        re, im, lost = state
        before, turn = math.hypot(re, im) + lost, 2 * w
        re, im = re + dt * rate * turn * math.cos(at), im + dt * rate * turn * math.sin(at)
        length = math.hypot(re, im)
        path = length + lost
        gone = slope(path) * (path - before)
        if gone > length:
            re, im, lost = 0.0, 0.0, lost + length
        else:
            left = 1 - gone / length if length > 0 else 1.0
            re, im, lost = re * left, im * left, lost + gone
        return (re, im, lost), (math.exp(-path * path), re, im, turn, lost, path)

    columns = "purity double, re double, im double, magnitude double, forgotten double, path double"
    return in_order(df, series, order, [weight, angle], lambda: (0.0, 0.0, 0.0), step, columns)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide: the same on any partitioning and after a lost executor."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(*parts: Column) -> Column:
    """A standard normal number that the parts alone decide."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, F.lit("r"))))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(*parts, F.lit("a")))


def gaussian(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, e): standard normal numbers, the same for a seed."""
    return spark.range(n).select(F.col("id").alias("i"), normal(F.lit(seed), F.col("id")).alias("e"))


def rotated(x: Column, y: Column, z: Column, axis: tuple[float, float, float], angle: Column) -> tuple[Column, Column, Column]:
    """A state's vector after a rotation by angle about an axis: what a pulse does to it."""
    size = math.sqrt(sum(a * a for a in axis))
    a, b, c = (F.lit(v / size) for v in axis)
    along, cos, sin = a * x + b * y + c * z, F.cos(angle), F.sin(angle)
    rest = along * (F.lit(1.0) - cos)
    return x * cos + (b * z - c * y) * sin + a * rest, y * cos + (c * x - a * z) * sin + b * rest, z * cos + (a * y - b * x) * sin + c * rest


def frames(df: DataFrame, series: str, order: list[str], x: str, y: str, z: str, most: int) -> DataFrame:
    """(frame, arrow end, its shadows on the three walls) of at most ``most`` evenly strided states per series, for an animation."""
    w = Window.partitionBy(series)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    stride = F.ceil(F.col("_n") / most)
    wall = F.lit(-1.0)
    return numbered.filter(F.col("_i") % stride == 0).select(
        series, (F.col("_i") / stride).cast("int").alias("frame"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"),
        F.array(wall, F.col(y), F.col(z)).alias("on_x"), F.array(F.col(x), wall, F.col(z)).alias("on_y"), F.array(F.col(x), F.col(y), wall).alias("on_z"),
    )


def drawn(df: DataFrame, series: str, t: str, value: str, bins: int) -> DataFrame:
    """The lowest and highest value of each of ``bins`` stretches of time per series: a plot of bounded size that loses no peak."""
    ends = df.groupBy(series).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    spread = df.join(ends, series).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(t) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).cast("int"))
    return spread.withColumn("bin", F.coalesce("bin", F.lit(0))).groupBy(series, "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
