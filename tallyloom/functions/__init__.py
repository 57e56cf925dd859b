"""Part of tallyloom; see README.md."""
