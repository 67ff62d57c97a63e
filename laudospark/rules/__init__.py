"""Rule tables: the data that drives every text operator."""
