"""PySpark-native analytics engine for data-independent-acquisition proteomics."""
