"""Validation of RDF data cubes on Spark."""
