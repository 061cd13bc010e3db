"""auditlake: code-audit and corpus analytics as PySpark DataFrame operators."""
