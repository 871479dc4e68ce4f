"""Scalar functions of the query language as Spark columns."""
