"""tallyline: Spark-native continuity checks for tabular pipelines."""

__version__ = "0.1.0"
#: Version of the receipt documents that this package writes.
SPEC_VERSION = "1.2"
