"""Training-data operators (tokens, WARC, near-duplicates, packing, media). Nothing else in the library imports this."""
