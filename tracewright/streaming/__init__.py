"""Views over growing folders."""
