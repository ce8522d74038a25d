"""Operations of a training-data pipeline: deduplication, packing, archives, tokens, search and quality."""
