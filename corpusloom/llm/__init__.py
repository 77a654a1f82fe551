"""Operators that prepare text collections for training language models. Nothing outside of this package imports it."""
