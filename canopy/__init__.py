"""canopy: constrained boosted-tree regression studies on Spark DataFrames.

Layout
------
sources/    scans (CSV, whitespace text, config, result read-back) and sinks
functions/  Column-expression builders (cleaning scalars, metrics, objectives)
operators/  DataFrame operators (cleaning, folds, selection, boosting, diagnostics)
plans/      compositions: dataset preparation, cross-validation, grid search,
            and the registry of named queries used by ``__spark_entry__``
streaming/  notes on streaming use (the reference has no streaming)
"""

__version__ = "0.1.0"
