"""Readers of documents and folders."""
