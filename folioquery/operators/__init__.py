"""Relational operators over documents, records, pages and events."""
