"""Connected components, as the rest of the library has them."""

from __future__ import annotations

from tidemill.operators.components import connected_components

__all__ = ["connected_components"]
