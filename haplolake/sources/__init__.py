"""Sources and sinks: sequence files, id files, delimited tables, keyed writers."""
