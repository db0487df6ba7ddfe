"""A PySpark-native engine for conversational records."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: what a task uses of it travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
