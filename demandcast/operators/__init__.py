"""Lazy operators: DataFrame in, DataFrame out, no actions."""
