"""Scalar functors, reductions and Givens rotations as Column expressions."""
