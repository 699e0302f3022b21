"""Analytics over coding-assistant session logs, on Spark."""
