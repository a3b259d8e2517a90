"""Conversation and document analytics on Spark: functions from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
