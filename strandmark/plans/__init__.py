"""Quality control and composite workflows."""
