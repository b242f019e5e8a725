"""DataFrame operators for building and scoring survey-catalogue samples on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with them, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources"]
