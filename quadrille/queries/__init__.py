"""Registered queries, each beside the SQL that another engine answers it with."""
