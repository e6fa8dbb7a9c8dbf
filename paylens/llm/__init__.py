"""Operators for preparing training data: near-duplicate removal, filtering, mixing, encoding and packing."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the job, so that executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
