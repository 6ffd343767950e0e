"""Reading polygons and publishing layers."""
