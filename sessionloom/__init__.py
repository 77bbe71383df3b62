"""Session-log analytics on Spark: tables in, tables out, for all sessions at once."""
