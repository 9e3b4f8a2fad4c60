"""Sources and sinks: driver tables, task tables, prediction/split/log files."""
