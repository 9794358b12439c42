"""Operators of the image-corpus toolkit."""
