"""Where models plug in: encoders, classifiers and pair scorers that run batch by batch in Python, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_texts(df: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], list]], kind: str) -> DataFrame:
    """(key, value): ``factory()`` gives, once a task, a function from a list of texts to a list of values of Spark type
    ``kind`` ('double' for a probability, 'array<float>' for an embedding). A null text counts as ''."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield pd.DataFrame({key: b[key], "value": model([t if isinstance(t, str) else "" for t in b["t"]])})

    return df.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {key_type}, value {kind}")


def map_pairs(df: DataFrame, keys: list[str], claim: str, evidence: str, factory: Callable[[], Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]], *, chars: int = 800, order: tuple[str, ...] = ("supports", "refutes", "nei")) -> DataFrame:
    """(keys..., p_supports, p_refutes, p_nei): the model gives three values for each (evidence, claim), in the given
    ``order`` of names (models often have refutes, nei, supports); the evidence is cut to ``chars``."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            pairs = [(e if isinstance(e, str) else "", c if isinstance(c, str) else "") for e, c in zip(b["e"], b["c"])]
            out = pd.DataFrame(model(pairs), columns=[f"p_{o}" for o in order], dtype=float)[["p_supports", "p_refutes", "p_nei"]]
            yield pd.concat([b[keys].reset_index(drop=True), out], axis=1)

    rows = df.select(*keys, F.col(claim).alias("c"), F.substring(evidence, 1, chars).alias("e"))
    return rows.mapInPandas(run, f"{schema}, p_supports double, p_refutes double, p_nei double")
