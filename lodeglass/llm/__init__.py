"""Operations on training text: extraction, tokens, filters, deduplication, shards and scans."""
