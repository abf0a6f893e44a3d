"""Part of tessella."""
