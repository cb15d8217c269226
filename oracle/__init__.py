"""DuckDB SQL that recomputes every registered query on the same tables."""
