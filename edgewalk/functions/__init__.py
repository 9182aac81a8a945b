"""Part of edgewalk."""
