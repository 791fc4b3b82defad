"""Sequence, variant and provenance analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few grouped functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
