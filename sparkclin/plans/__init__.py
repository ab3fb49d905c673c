"""Driver-side compilation of requests: search URLs, filters, the catalogue of parameters."""
