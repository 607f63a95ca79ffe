"""Reading raw posts and deriving the landing tables from the given Parquet tables."""
