"""histscore: score entities from their event histories with Spark DataFrames.

Modules:
  sources/    readers, prediction-set store, compact CSV sink, JSON metadata
  functions/  scalar column expressions (folds, sigmoid, smoothing, text)
  operators/  history aggregates, sequences, ordered-axis priors, ranks,
              metrics, blends, contracts, Spark ML training and scoring
  plans/      bindings of roles to the driver tables and the query catalogue
  streaming/  (the reference has no unbounded input; see its docstring)
"""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's functions (the per-partition passes handed to
    ``mapInPandas``) by value, so Python workers need no installed copy of
    the package and no extra files on the cluster."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
