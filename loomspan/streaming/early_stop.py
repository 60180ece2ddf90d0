"""STM-09: early-stop state (best value, values in a row above best * factor) kept per run over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "run string, step long, best double, bad long"
STATE = "best double, bad long"


def track(stream: DataFrame, factor: float) -> DataFrame:
    """stream (run, step, value) -> a row per step. Rows of a run are taken in step order inside a batch."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, bad = state.get if state.exists else (float("inf"), 0)
        steps, values = [np.concatenate(x) for x in zip(*[(f["step"].to_numpy(), f["value"].to_numpy()) for f in batches], strict=True)]
        order = np.argsort(steps, kind="stable")
        for at in range(0, len(order), 10_000):  # two numbers a step are held, rows are made some at a time
            rows = []
            for i in order[at : at + 10_000].tolist():
                best = min(best, float(values[i]))
                bad = bad + 1 if values[i] > best * factor else 0
                rows.append((key[0], int(steps[i]), best, bad))
            yield pd.DataFrame(rows, columns=["run", "step", "best", "bad"])
        state.update((best, bad))

    return stream.groupBy("run").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")
