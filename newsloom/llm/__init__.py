"""Operations of a training-data pipeline: dedup, search, scoring, scrubbing, mixing, token files."""
