"""Operators for large-scale training-data pipelines.

Each module holds one operator; ``queries`` maps them onto the shared tables.
The subpackage is self-contained: nothing else in the library imports it.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
