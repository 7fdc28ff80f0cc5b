"""synthweave: Spark-native building blocks for synthetic instruction data.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark's own expressions, joins, windows and aggregates.  Sub-packages:

* ``sources``   -- table loading, derived fixture views, file readers/writers
* ``functions`` -- reusable column expressions and fixed constants
* ``operators`` -- the operator catalogue (sampling, sharding, parsing, ...)
* ``plans``     -- composed jobs and the query registry used by the driver
* ``streaming`` -- row-local operators applied to ``readStream`` inputs
"""

from synthweave.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
