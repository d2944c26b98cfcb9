"""Sources and sinks: text, delimited, JSON, YAML, Markdown, pipe rows, workbooks, word processing files, word boxes."""
