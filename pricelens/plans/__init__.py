"""Reports and questions: whole queries over the tables."""
