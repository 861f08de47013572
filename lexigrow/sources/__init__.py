"""Readers and writers of the text formats: seeds, corpora, nets, embeddings, lexicons, annotations.

Readers return DataFrames and split files as Spark does.  Where the order of
lines counts, a line is named by its file, the block that holds it and its
number there, so that no task has to see a whole file.
"""
