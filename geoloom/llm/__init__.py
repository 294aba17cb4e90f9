"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Functions that run within
tasks are shipped by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
