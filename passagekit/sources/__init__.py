"""Readers, writers and the nested result document."""
