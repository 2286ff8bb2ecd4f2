"""Readers and writers of documents, change logs, index tables and results."""
