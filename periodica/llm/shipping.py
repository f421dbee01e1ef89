"""Python workers get this package from the driver, so a session need not have it on every machine's path."""

from ..functions.shipping import ship

__all__ = ["ship"]
