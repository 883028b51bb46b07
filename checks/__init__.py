"""The operators run over the given star-schema tables, each beside the SQL it must agree with."""
