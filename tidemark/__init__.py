"""Point-in-time panel analytics as lazy DataFrame-to-DataFrame functions on Spark."""
