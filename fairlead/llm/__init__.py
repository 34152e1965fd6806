"""Training-data operators: de-duplication, filters, formatting, tokens, shards and mixing."""
