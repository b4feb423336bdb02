"""Reading and writing of graphs, logs and texts."""
