"""Column-level (scalar) functions: pure ``Column -> Column`` builders."""
