"""A small feed-forward network: forward runs as an Arrow UDF, training on a bounded sample on the driver, weights as text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a network is fitted on at most.
FIT_ROWS = 10_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Outputs for rows of inputs; each layer has a bias as the last row of its weights. No state is kept between rows."""
    for w in weights:
        x = sigmoid(np.c_[x, np.ones(len(x))] @ w)
    return x


def initial(sizes: list[int], seed: int) -> list[np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return [r.uniform(-0.5, 0.5, (a + 1, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]


def train(x: np.ndarray, y: np.ndarray, hidden: int = 4, rounds: int = 10_000, rate: float = 0.5, error: float = 1e-4, seed: int = 0) -> list[np.ndarray]:
    """Weights of one hidden layer by back-propagation over all rows, until the mean squared error falls below ``error``.

    More than ``FIT_ROWS`` rows raise: sample them first.
    """
    if len(x) > FIT_ROWS:
        raise ValueError(f"fit on at most {FIT_ROWS} rows")
    w = initial([x.shape[1], hidden, y.shape[1]], seed)
    for _ in range(rounds):
        inner = sigmoid(np.c_[x, np.ones(len(x))] @ w[0])
        out = sigmoid(np.c_[inner, np.ones(len(x))] @ w[1])
        miss = y - out
        if float((miss**2).mean()) < error:
            break
        top = miss * out * (1 - out)
        low = (top @ w[1][:-1].T) * inner * (1 - inner)
        w[1] += rate * np.c_[inner, np.ones(len(x))].T @ top / len(x)
        w[0] += rate * np.c_[x, np.ones(len(x))].T @ low / len(x)
    return w


def saved(weights: list[np.ndarray]) -> str:
    """The layers' sizes on the first line, then one line for each row of weights."""
    sizes = [weights[0].shape[0] - 1, *(w.shape[1] for w in weights)]
    return "\n".join([" ".join(map(str, sizes)), *(" ".join(repr(float(v)) for v in row) for w in weights for row in w)])


def loaded(text: str) -> list[np.ndarray]:
    lines = text.strip().split("\n")
    sizes, at, out = [int(v) for v in lines[0].split()], 1, []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        rows = [[float(v) for v in line.split()] for line in lines[at : at + a + 1]]
        if any(len(r) != b for r in rows) or len(rows) != a + 1:
            raise ValueError("the weights don't fit the sizes on the first line")
        out.append(np.array(rows))
        at += a + 1
    return out


def scored(weights: list[np.ndarray], features: list[Column]) -> Column:
    """Array of outputs; a null feature counts as 0."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in columns])
        return pd.Series(list(forward(weights, x)))

    return run(*features)


def peak_features() -> list[Column]:
    """Nine features of a peak, of our own choice: the reference gives only the interface of a classifier."""
    return [F.col(c).cast("double") for c in ("area_fractional", "no_noise_fraction", "symmetry", "width", "signal_to_noise", "fit_error", "sigma", "intensity", "rank")]
