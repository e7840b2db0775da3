"""Spark-native market analytics: long-form DataFrames in, long-form DataFrames out."""
import sys

from pyspark import cloudpickle

# executors need no installed copy of the library: its functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
