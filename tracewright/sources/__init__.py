"""Reading delimited text and writing views."""
