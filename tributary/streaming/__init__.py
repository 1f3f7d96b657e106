"""The row-wise stages over streams."""
