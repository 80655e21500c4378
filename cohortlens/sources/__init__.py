"""Readers, table audit and sinks."""
