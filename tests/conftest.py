import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallgram.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cpus=8)


@pytest.fixture
def to_rows(spark):
    """NumPy matrix -> row layout spread over partitions."""

    def make(a, partitions=4):
        data = [(i, [float(x) for x in row]) for i, row in enumerate(np.asarray(a))]
        df = spark.createDataFrame(data, "row_id bigint, vec array<double>")
        return df.repartition(partitions, "row_id")

    return make


@pytest.fixture
def to_entries(spark):
    def make(a):
        i, j = np.nonzero(a)
        data = [(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)]
        return spark.createDataFrame(data, "i bigint, j int, v double")

    return make


@pytest.fixture
def rng():
    return np.random.default_rng(3)


def dense(rows):
    """Row layout -> NumPy, in row order."""
    got = sorted(rows.collect(), key=lambda r: r.row_id)
    return np.array([list(r.vec) for r in got])


def dense_entries(entries, shape):
    out = np.zeros(shape)
    for r in entries.collect():
        out[r.i, r.j] += r.v
    return out


def sketch_of(row):
    return np.array(row["data"]).reshape(-1, row["m"])


def cov_err(a, b):
    return float(np.abs(np.linalg.eigvalsh(a.T @ a - b.T @ b)).max())
