"""Operations of a training-data pipeline as Spark jobs: counts, dedup, filters, tokens, archives."""
