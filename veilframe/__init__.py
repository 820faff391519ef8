"""Data masking, classification, packaging and generation expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# the few Python functions travel with the plan, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
