"""Sources and sinks: text, binary records, count matrices, reads."""
