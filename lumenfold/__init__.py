"""A PySpark-native engine for customer-record, document and corpus analytics."""
