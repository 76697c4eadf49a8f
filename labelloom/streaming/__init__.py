"""Running the row-wise operators on a stream of new texts."""
