"""PySpark-native engine for property-scale geospatial analytics."""

import sys

from pyspark import cloudpickle

# Functions used inside Arrow UDFs travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
