"""Column functions and the parsers and editors that stand behind UDFs."""
