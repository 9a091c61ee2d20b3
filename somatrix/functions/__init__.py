"""Part of somatrix."""
