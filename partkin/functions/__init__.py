"""Scalar functions as Column builders, without Python on the executors."""
