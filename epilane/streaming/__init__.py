"""Alignments that arrive while they are produced."""
