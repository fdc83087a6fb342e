"""Operators over DataFrames: mining, induction, matching, validation, baselines, metrics."""
