"""Operators over documents and their relations."""
