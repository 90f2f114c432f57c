"""Table access, text and binary formats, sinks."""
