"""Readers, derived traffic and sinks."""
