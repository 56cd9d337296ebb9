"""Tidemark: curation of web text on Spark, from raw pages to digests."""
