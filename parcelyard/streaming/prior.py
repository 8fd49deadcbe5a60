"""Beyond batch: counts and means so far of each key's earlier days, over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def prior_means(stream: DataFrame, key: str, at: str, value: str, late: str = "1 hour") -> DataFrame:
    """For each event: n and mean of its key's events of earlier days, as of the batches seen.

    State is a key's sums before its current day and of that day, so the same
    day never sees itself. Events later than the watermark are dropped; an
    event of a day before the current one sees the earlier days' sums.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, n0, s0, n1, s1 = state.get if state.exists else ("", 0, 0.0, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        for t, v in zip(rows[at], rows[value], strict=True):
            d = str(t)[:10]
            if d > day:
                day, n0, s0, n1, s1 = d, n0 + n1, s0 + s1, 0, 0.0
            out.append((group[0], t, v, n0, s0 / n0 if n0 else None))
            if d == day:
                n1, s1 = n1 + 1, s1 + v
            else:
                n0, s0 = n0 + 1, s0 + v
        state.update((day, n0, s0, n1, s1))
        yield pd.DataFrame(out, columns=[key, at, value, "prior_n", "prior_mean"])

    types = dict(stream.dtypes)
    rows = stream.withWatermark(at, late).where(F.col(value).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {types[key]}, {at} timestamp, {value} double, prior_n long, prior_mean double", "day string, n0 long, s0 double, n1 long, s1 double", "append", GroupStateTimeout.NoTimeout
    )
