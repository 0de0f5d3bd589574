"""Training-data operators. Self-contained: the rest of the library never imports it.

Functions sent to workers carry the code of this subpackage with them, so executors
need neither a copy of the repository nor its folder on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
