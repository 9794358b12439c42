"""Streaming of the image-corpus toolkit."""
