"""Training-data operators: each one is a DataFrame job; nothing outside this folder imports them."""
