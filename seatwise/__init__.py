"""seatwise: balanced cohort and capacity allocation as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame(s) -> DataFrame``. Sub-packages:

* ``sources``   -- file reads, profiles, fingerprints and the views derived from the test tables
* ``functions`` -- column expressions (cleaning, header normalising, similarity, codes)
* ``operators`` -- relational operators (rank, split, apportion, seating, reports, upsert, ...)
* ``plans``     -- the query catalogue used by ``__spark_entry__`` and its SQL oracle
* ``streaming`` -- Structured Streaming jobs (incremental ingest, live counts)
"""

from seatwise.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
