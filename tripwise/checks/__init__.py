"""Every operator as a query on the given tables, next to the SQL that must give the same rows."""
