"""tapestone: event studies, backtests and corpus preparation as Spark jobs."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value, so a cluster needs no installed copy.
register_pickle_by_value(sys.modules[__name__])
