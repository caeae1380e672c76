"""sessionloom: a PySpark-native analytics engine for session timelines.

Every operator takes DataFrames and returns a DataFrame.  Functions that run
inside Python tasks are pickled by value, so executors need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
