"""Physical-layout planning and end-to-end compositions."""
