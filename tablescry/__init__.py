"""A PySpark-native engine for inspecting, querying and converting tables and data files.

Functions of this package travel to executors by value, so a cluster needs no
installed copy of it beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
