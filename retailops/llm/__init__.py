"""Training-data operators: scans, filters, near duplicates, mixing, models, token counts.

Nothing else in the library imports this subpackage. Functions that run in Spark's Python
workers are shipped by value, so a worker needs no copy of this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
