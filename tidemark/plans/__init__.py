"""Composite tables built from the operators as one lazy plan each."""
