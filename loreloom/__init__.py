"""Loreloom: document retrieval, retrieval evaluation and usage analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task code travels with its task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
