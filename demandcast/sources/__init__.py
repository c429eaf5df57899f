"""Reading inputs and writing results."""
