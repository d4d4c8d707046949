"""Operators for preparing model training data.  Nothing outside this subpackage imports it."""
