"""Operators for preparing text corpora for model training; nothing else in the library imports them."""
