"""Pluggable models: a registry with explicit states, and batched inference through Arrow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READY, DISABLED, UNAVAILABLE = "READY", "DISABLED", "UNAVAILABLE"


@dataclass(frozen=True)
class Model:
    """A name, a state, and what turns a matrix of features into one of scores; there is none unless READY."""

    name: str
    state: str
    predict: Callable[[np.ndarray], np.ndarray] | None = None


class Registry:
    """Models by name. A model that is missing is UNAVAILABLE; nothing stands in for it silently."""

    def __init__(self) -> None:
        self._models: dict[str, Model] = {}

    def add(self, name: str, predict: Callable[[np.ndarray], np.ndarray] | None, enabled: bool = True) -> Model:
        """Adds a model; without predict it is UNAVAILABLE, and not enabled it is DISABLED."""
        state = DISABLED if not enabled else UNAVAILABLE if predict is None else READY
        self._models[name] = Model(name, state, predict if state == READY else None)
        return self._models[name]

    def add_onnx(self, name: str, path: str) -> Model:
        """Adds an ONNX file; UNAVAILABLE if it cannot be loaded."""
        try:
            import onnxruntime

            session = onnxruntime.InferenceSession(path)
            feed = session.get_inputs()[0].name
            return self.add(name, lambda x: session.run(None, {feed: x.astype(np.float32)})[0])
        except Exception:  # noqa: BLE001 - whatever keeps a file from loading makes it unavailable
            return self.add(name, None)

    def get(self, name: str) -> Model:
        return self._models.get(name, Model(name, UNAVAILABLE))


def score(df: DataFrame, model: Model, features: list[str], out: str) -> DataFrame:
    """df with a score by model, null unless it is READY, and <out>_state."""
    if model.predict is None:
        return df.withColumn(out, F.lit(None).cast("double")).withColumn(f"{out}_state", F.lit(model.state))
    predict = model.predict

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(np.column_stack([c.to_numpy(float) for c in columns])), float).reshape(len(columns[0]), -1)[:, 0])

    return df.withColumn(out, run(*features)).withColumn(f"{out}_state", F.lit(model.state))


def slots(values: list[float], count: int = 24, size: int = 5, pad: int = 15, lead: int = 10, width: int = 512) -> np.ndarray:
    """Values dealt into padded slots of a buffer, the form that a one-dimensional network reads."""
    buffer = np.zeros(width, np.float32)
    for s in range(min(count, len(values) // size)):
        at = lead + s * (size + pad)
        buffer[at : at + size] = values[s * size : (s + 1) * size]
    return buffer
