"""Whole runs made of the operators, and the command line."""
