"""Named queries over the adapter's tables, with DuckDB SQL for each that SQL can express."""
