"""Operators for text and vector collections that feed model training.  Nothing outside this subpackage imports it."""
