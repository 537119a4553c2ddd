"""Column-level functions: text, keys, classification, encoders."""
