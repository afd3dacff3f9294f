"""Whole runs: compositions of sources, operators and sinks."""
