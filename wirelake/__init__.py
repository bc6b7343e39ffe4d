"""Analytics over application-layer network traffic, declared as Spark plans."""
