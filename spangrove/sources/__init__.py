"""Files as tables, and tables as the text files other tools read."""
