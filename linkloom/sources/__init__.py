"""Tables in and out: registry files, captured responses, link snapshots, record sinks."""
