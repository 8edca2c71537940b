"""Training-data operators over document and web tables (licence scan, URL filter, token counts, ...)."""
