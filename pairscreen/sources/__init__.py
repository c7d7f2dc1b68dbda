"""Files to tables and back."""
