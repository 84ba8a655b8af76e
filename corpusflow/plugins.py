"""Extension points: batched row mappers (the others are ``tokenizers.plug_in``, ``templates.register_template`` and
``scoring.score_streams``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """UDF-01: a mapper over Arrow batches that may return fewer or more rows than it got."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield fn(frame)

    return df.mapInPandas(run, schema)
