"""Health-economics tables and training-data preparation as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the executors whole, so it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
