"""Curate, search, embed and pair a corpus of scholarly papers on Spark."""
