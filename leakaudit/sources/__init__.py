"""Readers, bound-parameter SQL, sinks and stage tables."""
