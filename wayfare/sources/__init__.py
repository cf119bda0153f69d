"""Readers, schema reconciliation and writers."""
