"""tallyloom: reconciliation and spending audit on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so that a cluster needs no copy
# of this package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
