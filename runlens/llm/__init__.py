"""Operators of a training-data pipeline. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
