"""Numeric and array functions (MTH, ARR, MAP): column builders."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def schedule(n: int, alpha: float | None = None) -> Column:
    """MTH-01: n + 1 times from 0 to 1, uniform or shifted on the noise side tau = 1 - t."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(n))
        if alpha is None:
            return t
        tau = F.lit(1.0) - t
        return F.lit(1.0) - F.lit(alpha) * tau / (F.lit(1.0) + F.lit(alpha - 1.0) * tau)

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def shift_mean(alpha: float) -> float:
    """MTH-02."""
    return -math.log(alpha)


def logit_normal(z: Column, m: float = 0.0, s: float = 1.0) -> Column:
    """MTH-02: time from a standard normal draw."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * F.lit(s) + F.lit(m))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, scale: float = 1.0) -> Column:
    """MTH-03."""
    return F.lit(scale) * dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mse(a: Column, b: Column) -> Column:
    """MTH-05: mean squared difference of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def gauss_logp(x: Column, mean: Column, sd: Column) -> Column:
    """MTH-06: Gaussian log-density averaged over dimensions."""
    return -mse(x, mean) / (F.lit(2.0) * sd * sd) - F.log(sd) - F.lit(0.5 * math.log(2 * math.pi))


def sde_sigma(t: Column, t1: Column, a: float) -> Column:
    """MTH-07: noise of a step; the first step uses the second time."""
    return F.lit(a) * F.sqrt((F.lit(1.0) - t) / F.when(t > 0, t).otherwise(t1))


def sde_mean(x: Column, v: Column, t: Column, dt: Column, sigma: Column) -> Column:
    """MTH-07: mean of the next state."""
    s2, tau = sigma * sigma, F.lit(1.0) - t
    return x * (F.lit(1.0) - s2 * dt / (F.lit(2.0) * tau)) + v * (F.lit(1.0) + s2 * t / (F.lit(2.0) * tau)) * dt


def clipped_policy_loss(a: Column, ratio: Column, clip: float, a_clip: float = 5.0) -> Column:
    """MTH-09."""
    adv = F.greatest(F.lit(-a_clip), F.least(F.lit(a_clip), a))
    return F.greatest(-adv * ratio, -adv * F.greatest(F.lit(1.0 - clip), F.least(F.lit(1.0 + clip), ratio)))


def learning_rate(step: Column, base: float, warmup: int, total: int | None = None, decay_start: int | None = None) -> Column:
    """MTH-10: warm-up, constant, linear decay."""
    lr = F.lit(base) * F.least(F.lit(1.0), (step + 1) / F.lit(float(max(warmup, 1))))
    if total and decay_start is not None:
        lr = F.when(step >= decay_start, lr * F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(total - decay_start, 1))))).otherwise(lr)
    return lr


def whiten(z: Column, mean: Column, std: Column) -> Column:
    """MTH-11."""
    return F.zip_with(F.zip_with(z, mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s)


def unwhiten(z: Column, mean: Column, std: Column) -> Column:
    """MTH-11."""
    return F.zip_with(F.zip_with(z, std, lambda x, s: x.cast("double") * s), mean, lambda x, m: x + m)


def traffic_light(x: Column, low: float, high: float) -> Column:
    """MTH-12."""
    return F.when(x.isNull() | F.isnan(x), "none").when(x >= high, "good").when(x <= low, "bad").otherwise("mid")


def clamp_multiple(x: Column, step: int, low: int, high: int) -> Column:
    """MTH-13: into [low, high], down to a multiple of step."""
    return (F.floor(F.greatest(F.lit(low), F.least(F.lit(high), x)) / F.lit(step)) * F.lit(step)).cast("bigint")


def to_u8(a: Column) -> Column:
    """MTH-16: values scaled so that the largest is 255, cut to integers."""
    top = F.greatest(F.array_max(a).cast("double"), F.lit(1e-9))
    return F.transform(a, lambda x: F.floor(x.cast("double") / top * F.lit(255.0)).cast("int"))


def pad(a: Column, n: int, fill: Column) -> Column:
    """ARR-04: right-padded to n."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def pick(a: Column, u: Column) -> Column:
    """ARR-02: a random element, by a uniform draw."""
    return F.get(a, F.floor(u * F.size(a)).cast("int"))


def get_or(m: Column, key: str, default: Column) -> Column:
    """MAP-01."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)
