"""Training-data operators: deduplication, tokens, scores, media, pages and mixes."""
