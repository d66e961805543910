"""Parameters and the compression plans."""
