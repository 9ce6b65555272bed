"""Column functions: everything here is a plain Catalyst expression."""

from .hashing import (
    PRIME,
    fourwise_sign,
    gaussian_hash,
    pairwise_bucket,
    random_bucket,
    random_sign,
    uniform_hash,
)
from .vectors import required, shrink_value, sq_distance, sq_norm, vector_sum

__all__ = [
    "PRIME",
    "fourwise_sign",
    "gaussian_hash",
    "pairwise_bucket",
    "random_bucket",
    "random_sign",
    "required",
    "uniform_hash",
    "shrink_value",
    "sq_distance",
    "sq_norm",
    "vector_sum",
]
