"""corvane: retrieval, evidence and text-corpus analytics as PySpark DataFrame programs."""
