"""Derivations between source records and the model tables that queries read."""
