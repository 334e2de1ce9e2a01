"""Reading and writing images and vectors."""
