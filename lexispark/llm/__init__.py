"""Operations of a training-data pipeline: scoring, formatting, deduplication, mixing, archives, search."""

import sys

from pyspark import cloudpickle

# What runs on executors is sent to them, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
