"""The jobs: ingest, curate, and their summaries."""
