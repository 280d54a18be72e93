"""The engine's operators over the provided test tables, with the same queries in SQL to compare."""
