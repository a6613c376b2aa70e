"""Column functions and date-window helpers."""
