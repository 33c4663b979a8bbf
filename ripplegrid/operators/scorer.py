"""Scoring windows by a causal dilated convolution, and state that is chained along an episode.

The network's weights are given; nothing is trained here. Windows are arrays of steps, scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DILATIONS = (1, 2, 4)
TAPS = 3


class CausalNet:
    """Layers of dilated causal convolutions with ReLU and a linear head on the last step: (batch, steps, fields) -> (batch,)."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], head: tuple[np.ndarray, float]):
        self.layers, self.head = layers, head

    @staticmethod
    def given(fields: int, width: int, seed: int = 0) -> CausalNet:
        """Seeded weights, for tests and dry runs."""
        rng = np.random.default_rng(seed)
        sizes = [fields, *[width] * len(DILATIONS)]
        layers = [(rng.normal(0, 1 / np.sqrt(TAPS * a), (TAPS, a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        return CausalNet(layers, (rng.normal(0, 1 / np.sqrt(width), width), 0.0))

    def to_dict(self) -> dict:
        """The weights as lists, for a file."""
        return {"layers": [{"weight": w.tolist(), "bias": b.tolist()} for w, b in self.layers], "head": {"weight": self.head[0].tolist(), "bias": float(self.head[1])}}

    @staticmethod
    def from_dict(weights: dict) -> CausalNet:
        """The network of weights that to_dict() gave; layers that do not fit one another are an error."""
        layers = [(np.array(x["weight"], dtype=float), np.array(x["bias"], dtype=float)) for x in weights["layers"]]
        head = (np.array(weights["head"]["weight"], dtype=float), float(weights["head"]["bias"]))
        sizes = [w.shape for w, _ in layers]
        if len(layers) != len(DILATIONS) or any(len(s) != 3 or s[0] != TAPS for s in sizes) or any(a[2] != b[1] for a, b in zip(sizes[:-1], sizes[1:], strict=True)) or head[0].shape != (sizes[-1][2],):
            raise ValueError(f"weights of other shapes: {sizes}")
        return CausalNet(layers, head)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for (weight, bias), gap in zip(self.layers, DILATIONS, strict=True):
            padded = np.pad(x, ((0, 0), (gap * (TAPS - 1), 0), (0, 0)))
            steps = x.shape[1]
            x = np.maximum(sum(padded[:, t * gap : t * gap + steps] @ weight[t] for t in range(TAPS)) + bias, 0)
        return x[:, -1] @ self.head[0] + self.head[1]


def score_windows(windows: DataFrame, keys: list[str], columns: list[str], net: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys and score: the net on the windows, one array column a field; all windows have the same length."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(batch[c].flatten(), dtype=float).reshape(batch.num_rows, -1) for c in columns], axis=2)
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(net(x))], names=[*keys, "score"])

    schema = T.StructType([*windows.select(*keys).schema.fields, T.StructField("score", T.DoubleType())])
    return windows.select(*keys, *columns).mapInArrow(run, schema)


def chained(pieces: DataFrame, episode: str, order: str, inflow: str, outflow: str, start: float, low: float, high: float) -> DataFrame:
    """episode, order, level: a level that each piece takes over from the one before and that stays within bounds.

    What a piece ends with depends on all before it, so an episode is one group; episodes are bounded by their length."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        level, levels = start, []
        for change in (pdf[inflow] - pdf[outflow]).tolist():
            level = min(high, max(low, level + change))
            levels.append(level)
        return pd.DataFrame({episode: pdf[episode], order: pdf[order], "level": levels})

    schema = T.StructType([*pieces.select(episode, order).schema.fields, T.StructField("level", T.DoubleType())])
    return pieces.groupBy(episode).applyInPandas(walk, schema)


def denormalised(rows: DataFrame, columns: list[str], scale: float, reference: list[str] | None = None) -> DataFrame:
    """rows with the columns back in units: times the scale, and on top of the reference where the network predicts changes against it."""
    return rows.withColumns({c: F.col(c) * scale + (F.col(reference[i]) if reference else F.lit(0.0)) for i, c in enumerate(columns)})


def at_step(rows: DataFrame, episode: str, step: str, n: int) -> DataFrame:
    """The rows of one step of every episode: the n-th of its distinct steps from 0, or from the end if n is negative; an episode without it has none."""
    steps = rows.select(episode, step).distinct()
    order = F.col(step) if n >= 0 else F.desc(step)
    place = F.row_number().over(Window.partitionBy(episode).orderBy(order)) - 1
    return rows.join(steps.withColumn("__n", place).where(F.col("__n") == (n if n >= 0 else -n - 1)).drop("__n"), [episode, step], "left_semi")
