"""Training-data operators (chat, dedup, mixing, tokens, archives, search, quality)."""
