"""Reading corpora, writing and reading models and intermediate tables."""
