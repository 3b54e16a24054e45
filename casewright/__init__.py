"""casewright: a PySpark-native engine for citation graphs and the documents behind them.

Every public function takes and returns DataFrames.  Nothing outside ``casewright.llm`` imports that
subpackage, so it can be removed without touching the rest.
"""

import sys

from pyspark import cloudpickle

# Python stages are shipped to executors by value: a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
