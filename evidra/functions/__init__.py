"""Part of the evidra engine."""
