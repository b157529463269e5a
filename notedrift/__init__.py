"""notedrift: disclosure and text-factor analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``)
with explicit key and ordering arguments; nothing relies on row order.

Layout
------
``sources``    scans, sinks and the adapter views over the driver tables
``functions``  column expressions (periods, text, extraction rules)
``operators``  DataFrame operators (cleaning, joins, revisions, buckets,
               TF-IDF, features, models, metrics, statistics)
``plans``      the registered queries and their DuckDB oracle texts
``streaming``  incremental ingestion of page files with the batch operators
"""

__version__ = "0.1.0"
