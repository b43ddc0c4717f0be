"""Gradient-boosted regression trees trained data-parallel on DataFrames.

Monotone constraints (with inherited bounds), missing values with a learned
side, native categorical splits, row and column subsampling, warm start,
masked-feature warm-up, and batched cross-validation with early stopping.
See ``fit.py`` for the job structure.
"""
