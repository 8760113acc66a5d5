"""The boundary to outside models: a function over Arrow batches, and the prompt sections that are given to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def echo(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The default model: every response is its prompt."""
    for frame in frames:
        yield frame.rename(columns={"prompt": "response"})


def apply_model(prompts: DataFrame, model: ModelFn = echo, key: str = "chunk_id") -> DataFrame:
    """(key, response) of prompts(key, prompt); the model sees batches, never the whole table."""
    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInPandas(model, f"{key} {kind}, response string")


def glossary_section(terms: DataFrame, key: str, kind: str, line: str, order: str) -> DataFrame:
    """(key, section): lines of each type under its name, types in order, lines in the order of ``order``."""
    blocks = terms.groupBy(key, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("body"))
    blocks = blocks.withColumn("block", F.concat(F.lit("**"), F.upper(kind), F.lit(":**\n"), F.col("body")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "block"))), lambda x: x["block"]), "\n\n").alias("section"))
