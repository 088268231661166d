"""Reports for people, scripts, CI and maps."""
