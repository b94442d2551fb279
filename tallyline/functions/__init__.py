"""Column functions: canonical cells, numbers in text, day keys, periods, formats."""
