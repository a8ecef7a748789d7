"""Vicinal: exact nearest-neighbour search and its reporting layer as ordinary Spark plans."""
