"""Corpus preparation, hybrid retrieval and retrieval evaluation on Spark.

Python functions that run on executors are pickled by value, so workers need not have the library on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
