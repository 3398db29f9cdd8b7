"""Streams of changes. An extension of our own: the operators elsewhere are for tables at rest."""
