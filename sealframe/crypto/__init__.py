"""Keys: providers, caching, health, and Parquet encryption options."""
