"""Incremental ingestion of paginated JSON, expressed as Spark DataFrame jobs.

Every table carries ``source_id`` (and ``run_id``), so one plan serves any
number of sources.  Operators are ``DataFrame -> DataFrame`` functions.
"""

__version__ = "0.1.0"
