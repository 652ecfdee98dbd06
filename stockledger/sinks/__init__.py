"""Written results: the snapshot store and report exports."""
