"""Operators of a training-data pipeline; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of these modules go to the executors with the job, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
