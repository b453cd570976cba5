"""Spark-native telemetry analytics: admission, storage, windows and live views."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from gaugeflow.session import build_session, configure

# Tasks receive the library's Python functions by value: workers need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]
