"""Operators put together into the analyses: gates over many sets, context tests, split survival, detection."""
