"""Operators for preparing training text. Nothing outside this subpackage imports it.

Functions that run on executors travel by value, so a cluster needs no copy of this package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
