"""Fathom: text retrieval and corpus analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
