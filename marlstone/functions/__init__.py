"""Part of the marlstone package."""
