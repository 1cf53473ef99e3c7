"""Readers, writers and the mapping of input tables to the graph model."""
