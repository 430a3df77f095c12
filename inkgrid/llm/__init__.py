"""Training-data operators: each module is one operator with DataFrame in and DataFrame out."""
