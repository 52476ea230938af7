"""A PySpark engine for bills of materials: reuse across variants, and the checks that make it safe."""
