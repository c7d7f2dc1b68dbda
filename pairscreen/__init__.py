"""Pair screening over embedded sequences, as ordinary Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the few task functions with the job itself, so the package need
# not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
