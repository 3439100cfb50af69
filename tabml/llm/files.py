"""Files in the shared folder, read and written inside tasks."""

from __future__ import annotations

from tabml.session import open_folder

__all__ = ["open_folder"]
