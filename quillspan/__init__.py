"""quillspan: a PySpark-native engine for compiling, auditing and searching collections of structured technical documents."""

__version__ = "0.1.0"
