"""Operators for preparing training text. Nothing else in the library imports this folder.

Functions that run inside tasks travel with the job, so executors need numpy, pyarrow and
xxhash but no copy of this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
