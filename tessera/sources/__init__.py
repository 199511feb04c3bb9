"""Containers: building vectors, matrices and flat buffers from tables or local data, and taking them out again."""

from tessera.sources.containers import batch_matrix, buffer, collect_matrix, collect_vector, fill, matrix, matrix_of_rows, parquet_vector, to_buffer, vector

__all__ = ["batch_matrix", "buffer", "collect_matrix", "collect_vector", "fill", "matrix", "matrix_of_rows", "parquet_vector", "to_buffer", "vector"]
