"""Tables, requests, fetched payloads and the rows inside them."""
