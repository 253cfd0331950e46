"""Feature frames and matrix operators as DataFrame plans."""
