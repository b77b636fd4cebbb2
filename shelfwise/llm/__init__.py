"""Training-data operators: ten independent operators over text, vector and media columns."""
