"""Readers and writers, and providers that find nodes and edges in project files."""
