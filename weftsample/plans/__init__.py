"""Complete sampled joins, put together from the operators."""
