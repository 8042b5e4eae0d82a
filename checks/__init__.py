"""Plain SQL versions of the queries, written apart from the engine, to check it against."""
