"""Plans of the image-corpus toolkit."""
