"""File sources, sinks and the table store."""
