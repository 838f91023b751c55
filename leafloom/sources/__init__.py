"""Readers, writers and tables derived from them."""
