"""Manifests, archives as tables, and raw tensor files."""
