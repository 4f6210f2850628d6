"""Sources: parquet scans, test-data views and the workbook ingest job."""
