"""Sources of the image-corpus toolkit."""
