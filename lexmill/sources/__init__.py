"""Readers of files: corpora, documents, names, labels, taxonomies, proposals."""
