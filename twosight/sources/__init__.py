from twosight.sources.tables import SCHEMAS, read_csv, read_parquet, read_tsv

__all__ = ["SCHEMAS", "read_csv", "read_parquet", "read_tsv"]
