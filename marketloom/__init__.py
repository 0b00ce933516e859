"""marketloom: market-intelligence analytics as PySpark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
