"""Reading tables from files and frames."""

from lodestone.sources.readers import (
    bound_batches,
    column_names,
    csv_fields,
    frame_source,
    json_keys,
    numbered,
    parquet_metadata,
    parquet_row_groups,
    read_source,
    row_at,
    scratch,
    settled,
    to_csv,
)

__all__ = ["bound_batches", "column_names", "csv_fields", "frame_source", "json_keys", "numbered", "parquet_metadata", "parquet_row_groups", "read_source", "row_at", "scratch", "settled", "to_csv"]
