"""Clause analytics as PySpark DataFrame operators.

Layers: ``functions`` are column expressions, ``operators`` take and return
DataFrames, ``sources`` read and write the stage files, ``plans`` chain the
operators into whole jobs, ``streaming`` runs them on arriving files.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the package's code with them, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
