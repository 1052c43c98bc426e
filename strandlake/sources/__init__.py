"""Readers and sinks of the file formats that genomic scans use; schemas are given, never inferred."""
