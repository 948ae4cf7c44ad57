"""The same steps over a stream of landing pages."""
