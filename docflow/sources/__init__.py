"""Scans, object-store semantics and sinks."""
