"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run on executors travel with the task, so no copy of this package has to
be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
