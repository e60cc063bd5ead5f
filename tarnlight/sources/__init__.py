"""Readers and writers of alignments, feature matrices, labels, weights, distances and results."""
