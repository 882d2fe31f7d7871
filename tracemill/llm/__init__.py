"""Operations of a training-data pipeline: quality signals, deduplication, formatting and mixing."""
