"""Embeddings of texts by a model of the caller's, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What queries (not documents) are prefixed with (fixed value of the model family).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DIMENSIONS = 768

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(df: DataFrame, text: str, load: Callable[[], Encoder] | None, output: str = "embedding", query: bool = False, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds ``output``: an array of ``dimensions`` floats per non-null text; null throughout where there is no model.

    ``load`` runs once per task and returns the encoder; without one (``None``) searches fall back on keywords.
    """
    if load is None:
        return df.withColumn(output, F.lit(None).cast("array<float>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            known = frame[text].notna()
            texts = [(QUERY_PREFIX if query else "") + t for t in frame.loc[known, text]]
            found = iter(encode(texts) if texts else [])
            frame[output] = [[float(x) for x in next(found)] if k else None for k in known]
            yield frame

    made = df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {output} array<float>")
    return made.withColumn(output, _checked(F.col(output), dimensions))


def _checked(vector: Column, dimensions: int) -> Column:
    wrong = F.concat(F.lit(f"an embedding must have {dimensions} dimensions, not "), F.size(vector).cast("string"))
    return F.when(vector.isNull() | (F.size(vector) == dimensions), vector).otherwise(F.raise_error(wrong))
