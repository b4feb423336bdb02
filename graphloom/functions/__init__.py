"""Scalar functions and pluggable providers."""
