"""Operators that prepare text corpora for training; see README, "Corpus operators"."""
