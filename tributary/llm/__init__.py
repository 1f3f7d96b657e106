"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this subpackage imports it. Functions that run on executors
are pickled by value, so a cluster needs no copy of this package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
