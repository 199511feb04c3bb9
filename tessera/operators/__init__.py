"""Vector, matrix-vector, matrix-matrix and extension operators over DataFrames."""
