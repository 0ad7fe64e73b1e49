"""Molecular-library data jobs, written as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
