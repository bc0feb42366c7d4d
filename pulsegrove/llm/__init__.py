"""Operators for corpora and labels; nothing outside this package imports it."""
