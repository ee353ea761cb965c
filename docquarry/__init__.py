"""A Spark-native document index and full-text search engine.

Functions that run in Python workers travel by value, so executors need the libraries but not this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
