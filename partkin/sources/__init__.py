"""Readers and writers of the raw files, the specification and the artifacts."""
