"""Column builders: projection, travel time, velocity lookup and portable random numbers."""
