"""URL fetch with retries (SRC-13): bytes or a reason, never an exception for one item (STM-12)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Answers that no retry mends, attempts, seconds before a retry times its number.
GONE = (403, 404, 410)
ATTEMPTS, BACK_OFF = 3, 1.5


def http_get(url: str, timeout: float = 20.0) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "loomspan"}), timeout=timeout) as r:
        return r.read()


def attempt(get: Callable[[str], bytes], url: str, wait: Callable[[float], None] = time.sleep, back_off: float = BACK_OFF) -> tuple[bytes | None, str | None]:
    reason = "no url"
    for k in range(ATTEMPTS if url else 0):
        try:
            return get(url), None
        except Exception as e:  # noqa: BLE001  (any failure of an item is a reason)
            reason = f"{type(e).__name__}: {e}"[:200]
            if getattr(e, "code", None) in GONE:
                break
            if k < ATTEMPTS - 1:
                wait(back_off * (k + 1))
    return None, reason


def fetched(df: DataFrame, url: str, at_once: int, get: Callable[[str], bytes] = http_get, back_off: float = BACK_OFF) -> DataFrame:
    """df with data and error; `at_once` tasks bound how many requests run together."""

    @F.pandas_udf("data binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([attempt(get, u, back_off=back_off) for u in urls], columns=["data", "error"])

    return df.repartition(at_once).withColumn("_f", run(url)).select("*", "_f.data", "_f.error").drop("_f")
