"""Comment-position analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to executors by value, so a job needs no copy
# of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
