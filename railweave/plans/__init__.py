"""Searches over a network: rounds of DataFrames for many queries at once, kernels for sequential searches."""
