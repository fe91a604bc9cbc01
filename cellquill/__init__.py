"""Spark-first analytics for single-cell sequencing records, with a separate training-data toolkit in ``llm``."""

__version__ = "0.1.0"

#: How to cite the package.
CITATION = f"cellquill, version {__version__}: Spark-first analytics for single-cell sequencing records."
