"""The queries of the driver contract and their SQL counterparts."""
