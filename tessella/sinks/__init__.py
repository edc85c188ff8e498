"""Reports, review payloads and edits written from issues."""
