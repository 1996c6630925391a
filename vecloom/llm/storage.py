"""Tables in the shared folder."""

from vecloom.sources.shared import Scratch, discard, shared_folder, table

__all__ = ["Scratch", "discard", "shared_folder", "table"]
