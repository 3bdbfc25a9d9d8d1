"""Operators for training-data pipelines over text tables."""

import sys

from pyspark import cloudpickle

# Functions travel to the tasks whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
