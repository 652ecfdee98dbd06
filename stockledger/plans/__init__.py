"""The data products a caller asks for."""
