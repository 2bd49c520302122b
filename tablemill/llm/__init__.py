"""Operators for preparing training data: filters, scores, near duplicates, search, packing, tokens."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with their code, so that workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
