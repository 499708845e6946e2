"""Plans shown as tables, statistics of tables, and advice drawn from queries."""
