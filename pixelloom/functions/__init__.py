"""Functions of the image-corpus toolkit."""
