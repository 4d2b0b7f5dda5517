"""Sequencing and DNA-methylation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers may not have this package on their path, so its few functions that run
# in tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
