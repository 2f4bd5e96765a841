"""Readers that turn delimited and text inputs into the long tables, and table sinks."""
