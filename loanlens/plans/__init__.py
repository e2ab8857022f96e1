"""Registered queries over the test tables, each with a checking SQL where one can be written."""
