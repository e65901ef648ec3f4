"""Readers, writers, selectors and generators."""
