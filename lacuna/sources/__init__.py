"""Readers and writers: Parquet with defaults, CSV, WAV, XML annotations, class dictionaries and file profiles."""
