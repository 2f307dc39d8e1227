"""Operations of a training-data pipeline. Nothing outside this package imports it.

Functions that run inside tasks travel by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
