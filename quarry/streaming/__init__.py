"""Streams (an extension: incremental ingestion)."""
