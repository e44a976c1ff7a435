"""Operators for training-data pipelines; functions travel to the workers by value, so workers need no copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
