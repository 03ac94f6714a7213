"""evweave — weighted-event analytics as Spark DataFrame, SQL and Spark ML jobs.

Subpackages:
  sources    readers, event view, partitioned writers (S*)
  functions  row-level column expressions: labels, losses, bins (L*)
  operators  selection, profiles, histograms, splits, scaling, ranking,
             resampling, models, metrics, sweeps
  plans      physical helpers: bucketed running sums / exact ranks
  streaming  the stateless operators on a file stream
  queries    registered queries with DuckDB oracle SQL
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions BY VALUE in Python UDFs, so executors
    need not have the package on their import path (no ``--py-files``)."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 — older cloudpickle: ship with --py-files instead
        pass


_ship_by_value()
