"""A host for models: loaded once in each Python worker, fed in Arrow batches; a failure becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.DataFrame]


def host(df: DataFrame, load: Callable[[], Model], schema: str, key: str) -> DataFrame:
    """What the model gives for each batch of df, with a reason column that is null where it worked.

    A batch that fails is tried again in halves, so that one bad clip costs its
    own row only; that row has its key, the reason, and nulls.
    """
    names = [f.split()[0] for f in schema.split(", ")] + ["reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def attempt(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                yield model(batch).assign(reason=None)
            except Exception as error:
                if len(batch) == 1:
                    yield pd.DataFrame({key: batch[key], "reason": f"{type(error).__name__}: {error}"}).reindex(columns=names)
                else:
                    half = len(batch) // 2
                    yield from attempt(batch.iloc[:half])
                    yield from attempt(batch.iloc[half:])

        for batch in batches:
            yield from attempt(batch)

    return df.mapInPandas(run, f"{schema}, reason string")


def worker_ids(text: str | None, available: int = 0) -> list[int]:
    """The ids that a text lists, such as "0, 2"; without a text all that are available, or -1 for none."""
    if text is None:
        return list(range(available)) or [-1]
    ids = [int(x) for x in text.split(",") if x.strip()]
    if not ids:
        raise ValueError("no worker ids")
    return ids
