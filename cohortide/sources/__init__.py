"""Reading clinical tables, keeping intermediate tables and writing results."""
