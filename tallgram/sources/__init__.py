"""Readers, writers, generators and table adapters."""

from .generate import (
    diagonal_matrix,
    identity_matrix,
    index_matrix,
    sparse_uniform,
    uniform_matrix,
    zero_matrix,
)
from .store import append_results, load_sketches, save_sketches, usable_sketches
from .tables import matrix_from_columns, matrix_from_vectors, pivot_to_sparse
from .text import (
    read_dense_text,
    read_matrix_market,
    read_word_vectors,
    stack_batches,
    text_shape,
    write_dense_text,
)

__all__ = [
    "append_results",
    "diagonal_matrix",
    "identity_matrix",
    "index_matrix",
    "load_sketches",
    "matrix_from_columns",
    "matrix_from_vectors",
    "pivot_to_sparse",
    "read_dense_text",
    "read_matrix_market",
    "read_word_vectors",
    "save_sketches",
    "sparse_uniform",
    "stack_batches",
    "text_shape",
    "uniform_matrix",
    "usable_sketches",
    "write_dense_text",
    "zero_matrix",
]
