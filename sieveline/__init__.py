"""Sieveline: a PySpark engine for choosing trustworthy training examples.

The core selects reliable rows from tables with one noisy class; the ``llm``
subpackage prepares text corpora and stands on its own.
"""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
