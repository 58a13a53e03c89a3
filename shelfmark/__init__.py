"""Estate analytics for Spark: catalogues, documents, plans and gates as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
