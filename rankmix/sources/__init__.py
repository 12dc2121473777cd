"""Sources and sinks: driver tables, derived score tables, score files."""
