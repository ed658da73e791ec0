"""terrapanel: Spark-native analytics for daily district soil-moisture panels.

Every public function takes and returns lazy ``DataFrame`` objects (or builds
``pyspark.ml`` models); no function collects row data to the driver except
bounded dimension checks.  Sub-packages:

* ``sources``   – CSV/Parquet/JSON/binary-file scans and sinks, table bindings
* ``functions`` – column-expression builders (calendar, advice, score vectors)
* ``operators`` – relational building blocks (cleaning, lookups, windows,
                  profiling, sampling, evaluation, models)
* ``plans``     – the composite user-level queries built from the operators
* ``streaming`` – incremental ingest of new reading files
"""

from terrapanel.session import get_session, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "materialize"]
