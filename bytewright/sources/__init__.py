"""Files in, archives out and in."""
