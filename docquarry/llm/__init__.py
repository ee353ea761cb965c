"""Operators for preparing language-model training data.

Ten operators and their queries.  Nothing outside this package imports it.  Functions that run in
Python workers travel by value, so executors need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
