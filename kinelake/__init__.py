"""Kinelake: scene sampling, motion labelling and annotation documents on Spark.

Every operator takes and returns DataFrames (or Columns); nothing here runs an
action unless its docstring says so. Functions sent to workers carry this package's
code with them, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
