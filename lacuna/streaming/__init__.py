"""Structured Streaming forms of the sequence operators (an extension: the batch operators define the results)."""
