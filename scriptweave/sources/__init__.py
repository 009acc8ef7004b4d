"""Reading transcripts, lexicons and lines; writing lines."""
