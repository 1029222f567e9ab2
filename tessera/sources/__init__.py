"""Settings, file scans and the snapshot store."""
