"""Kinetra: moving-object analytics and corpus preparation as PySpark DataFrame operators.

Functions that run in Python workers are shipped by value, so executors need
pandas, numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
