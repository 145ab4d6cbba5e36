"""Checks on the driver's tables: input roles, registered queries and their SQL."""
