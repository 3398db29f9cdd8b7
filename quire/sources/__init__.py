"""Readers and writers of the inputs: book archives and the two catalogue dumps."""
