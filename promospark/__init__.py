"""promospark: promotion-feed analytics on Spark DataFrames.

Modules:
  functions/  Column-level scalar functions (text, merchant, dates, urls, checksum)
  sources/    table readers, source specs and the driver-table feeds
  operators/  DataFrame operators (tiles, payloads, dedup, upsert, audit, query,
              aggregates, quality, runs)
  plans/      end-to-end plans (ingest, state store) and the query registry
  streaming/  Structured Streaming ingest (foreachBatch) and run-state folding
"""

__version__ = "0.1.0"
