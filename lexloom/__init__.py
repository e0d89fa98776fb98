"""lexloom: a Spark-native engine for legal-text analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with the task, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
