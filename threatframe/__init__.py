"""threatframe: security-alert analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   scans of landed alert pages, note pages and event tables; the
                versioned Parquet table store and result sinks.
* ``functions`` column-expression helpers (hex, ids, UUIDs, times, text).
* ``operators`` projections, filters, validation, joins, aggregations,
                ranking, upserts, splits, text features, resampling, models.
* ``plans``     composed jobs: ingest, train, score, evaluate, and the
                registered queries over the driver's test tables.
* ``streaming`` Structured Streaming forms of ingest, event match and dedupe.
"""

__version__ = "0.1.0"
