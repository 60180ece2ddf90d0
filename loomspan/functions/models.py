"""Model columns (UDF-01..04, UDF-06..11): contracts for pluggable scorers, loaded once a worker.

A factory builds the model; the engine hands it Arrow batches. Neural models themselves are not part of the engine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.lru_cache(maxsize=4)
def _loaded(factory: Callable[[], object]) -> object:
    return factory()


def scorer(factory: Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """UDF-01, UDF-04: (pictures, prompts) -> numbers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for pictures, prompts in batches:
            yield pd.Series(np.asarray(model(pictures, prompts), float))

    return run


def generator(factory: Callable[[], Callable[[pd.Series, pd.Series], list[str]]]) -> Callable[[Column, Column], Column]:
    """UDF-03: (pictures, prompts) -> texts."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for pictures, prompts in batches:
            yield pd.Series(model(pictures, prompts))

    return run


def encoder(factory: Callable[[], Callable[[pd.Series], list]], size: int = 64) -> Callable[[Column], Column]:
    """UDF-06..08: binary -> vectors, `size` rows at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for b in batches:
            yield pd.Series([v for at in range(0, len(b), size) for v in model(b.iloc[at : at + size])])

    return run


def sampler(factory: Callable[[], Callable[[list[str], list[int], int, int], list[bytes]]], size: int = 64) -> Callable[[Column, Column, Column, Column], Column]:
    """UDF-09: (prompts, seeds, widths, heights) -> pictures. A batch has one size, at most `size` rows, and each row its own seed, so a picture does not depend on its batch."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for prompts, seeds, widths, heights in batches:
            out = pd.Series([None] * len(prompts), dtype=object)
            rows = pd.DataFrame({"p": prompts.to_numpy(), "s": seeds.to_numpy(), "w": widths.to_numpy(), "h": heights.to_numpy()})
            for (w, h), part in rows.groupby(["w", "h"], sort=False):
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    pictures = model(some["p"].tolist(), some["s"].tolist(), int(w), int(h))
                    if len(pictures) != len(some):
                        raise ValueError("a picture for each prompt")
                    for i, x in zip(some.index, pictures, strict=True):
                        out.iat[i] = x
            yield out

    return run


def detector(factory: Callable[[], Callable[[pd.Series], list[list[tuple[str, float]]]]]) -> Callable[[Column], Column]:
    """UDF-10: pictures -> for each its (label, confidence) pairs."""

    @F.pandas_udf("array<struct<label:string,confidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for pictures in batches:
            yield pd.Series([[{"label": a, "confidence": float(c)} for a, c in found] for found in model(pictures)])

    return run


def yes_probability(yes: Column, no: Column) -> Column:
    """UDF-02: from the logits of the words that mean yes and of those that mean no."""

    def lse(a: Column) -> Column:
        top = F.array_max(a)
        return top + F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))

    return F.lit(1.0) / (F.lit(1.0) + F.exp(lse(no) - lse(yes)))


def by_shape(df: DataFrame, shape: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """AGG-29: batches of one shape. Rows stream through in shape order, so a common shape is never one group in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, part in f.groupby(shape, sort=False):
                yield fn(part)

    return df.sortWithinPartitions(shape).mapInPandas(run, schema)


STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sat", "sharp", "contrast")])


@F.pandas_udf(STATS)
def pixel_stats(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """MTH-15: mean saturation, variance of the Laplacian and deviation of grey, from interleaved 8-bit RGB bytes."""
    out = []
    for data, h, w in zip(pixels, height, width, strict=True):
        x = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
        top, low = x.max(axis=2), x.min(axis=2)
        sat = np.where(top > 0, (top - low) / np.maximum(top, 1), 0)
        g = np.floor(x @ np.array([0.299, 0.587, 0.114]) + 0.5)
        lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
        out.append((sat.mean(), lap.var() if lap.size else 0.0, g.std() / 255))
    return pd.DataFrame(out, columns=["sat", "sharp", "contrast"])
