"""Readers and writers: corpora, dictionaries, expositions, model connectors."""
