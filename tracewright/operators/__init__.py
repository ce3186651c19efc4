"""Views of a timeline: search, order, groups, marks, pages."""
