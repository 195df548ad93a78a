"""Queries over the fixture tables, one or more for each operator, beside SQL that says the same."""
