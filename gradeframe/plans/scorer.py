"""The one hook for caller-supplied models: Arrow batches in, a number or a problem for each row out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Returns one value a row, or a frame with ``value`` and ``problem``, which is null where a row went well.
Scorer = Callable[[pd.DataFrame], "pd.Series | pd.DataFrame"]


def apply_scorer(
    df: DataFrame, scorer: Scorer, output: str, setup: Callable[[], object] | None = None
) -> DataFrame:
    """Add ``output`` (double) and ``problem`` (string) to every row.

    The scorer gets a pandas batch and returns one value per row. A scorer that can tell
    which rows failed returns a frame with ``value`` and ``problem`` instead: rows with a
    problem score 0 and carry it, and the batch is not called again. When the call itself
    fails, halves of the batch are tried, and so on, so only the failing rows score 0 and
    carry the reason. ``setup`` runs once per Python task, for loading a model; its
    result is passed to the scorer as a second argument.
    """
    schema = StructType(
        [*df.schema.fields, StructField(output, DoubleType()), StructField("problem", StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = scorer
        if setup is not None:
            model = setup()
            call = lambda rows: scorer(rows, model)
        for batch in batches:
            scores = pd.Series(0.0, index=batch.index)
            problems = pd.Series(None, index=batch.index, dtype="object")
            parts = [batch] if len(batch) else []
            while parts:
                part = parts.pop()
                try:
                    told = call(part)
                    if isinstance(told, pd.DataFrame):
                        if len(told) != len(part):
                            raise ValueError(f"{len(told)} results for {len(part)} rows")
                        reasons = pd.Series(told["problem"].to_numpy(object), index=part.index)
                        reasons = reasons.where(reasons.notna(), None)
                        told = pd.to_numeric(told["value"]).to_numpy("float64")
                        scores.loc[part.index] = pd.Series(told, index=part.index).where(reasons.isna(), 0.0)
                        problems.loc[part.index] = reasons
                    else:
                        scores.loc[part.index] = pd.Series(told, index=part.index, dtype="float64")
                except Exception as reason:
                    if len(part) == 1:
                        problems.loc[part.index] = str(reason) or type(reason).__name__
                    else:
                        parts += [part.iloc[: len(part) // 2], part.iloc[len(part) // 2:]]
            yield batch.assign(**{output: scores, "problem": problems})

    return df.mapInPandas(run, schema)
