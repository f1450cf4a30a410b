"""Sources and sinks: batches of evidence, media files, perception rows and programs."""
