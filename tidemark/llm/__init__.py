"""Operators for preparing training data at scale; see README for the list.

Python code that runs in tasks is shipped with the task itself, so that executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
