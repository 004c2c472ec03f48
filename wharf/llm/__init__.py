"""Training-data operators: personal data, URL filters, duplicates, benchmark
leaks, licenses, toxicity, quality and source mixing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
