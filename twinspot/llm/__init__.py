"""Corpus operators for training-data work; nothing outside this folder imports them."""
