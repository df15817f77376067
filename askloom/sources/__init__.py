"""Readers and writers: question sets, SQL dumps, schema files, predictions."""
