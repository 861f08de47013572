"""Lexigrow: polarity-lexicon analytics on Spark DataFrames."""
