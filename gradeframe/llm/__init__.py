"""Operators for preparing training data, their queries and the SQL beside them.

Functions of this subpackage travel to the tasks by value, so executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
