"""Sources and sinks: files, JDBC, document stores and Kafka."""
