"""Analytics over collected asset inventories, as plain DataFrame operations."""
