"""Whole questions composed from the operators: digest, reader view, publish, refresh."""
