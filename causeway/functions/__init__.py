"""Column expressions: ``Column -> Column`` functions without Python workers."""
