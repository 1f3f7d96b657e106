"""Fusion of heterogeneous records about entities into one auditable profile each, as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are pickled by value, so a cluster needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
