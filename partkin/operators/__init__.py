"""Relational operators on the flat tables that ``normalize`` makes."""
