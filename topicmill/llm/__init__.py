"""Operators for preparing training data; nothing outside this folder imports it.

Functions that run on executors are shipped with their code, so workers need not
have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
