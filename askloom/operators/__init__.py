"""DataFrame operators: joins, groupings, model calls and the execution of SQL."""
