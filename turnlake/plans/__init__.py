"""Model tables and the queries over them."""
