"""A PySpark-native engine for collections of linked Markdown notes."""
