"""Sources and sinks: series tables in long form, model weights and loss logs."""
