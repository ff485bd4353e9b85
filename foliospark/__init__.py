"""Document intelligence on Spark: ingest, evaluate, retrieve."""

import sys

from pyspark import cloudpickle

from foliospark.session import build_session, materialise, tune_session

# Functions that run in tasks travel with the job, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialise", "tune_session"]
