"""Column-level helpers: exact money arithmetic and the wire payload codec."""
