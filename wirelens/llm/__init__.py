"""Operations of a training-data pipeline: tokens, fingerprints, near copies, filters, packing, scoring."""
