"""Consensus clustering of wide measurement tables on Spark.

Every public function takes DataFrames and returns DataFrames.  Two layouts are
used throughout:

* ``expr(dataset, sample_id, gene, value)``: long, one row per measured cell,
  NULL or an absent row = missing (``dataset`` only where several are loaded);
* ``samples(sample_id, features array<double>)``: one row per sample, after the
  feature count has been bounded by feature selection.
"""

import sys

from pyspark import cloudpickle

# Task functions of this package travel inside the job, so a cluster needs no
# copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
