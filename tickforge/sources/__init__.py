"""Where tables come from and where intermediate results go."""

from tickforge.sources.shared import shared_dir, write_shared
from tickforge.sources.tables import table

__all__ = ["shared_dir", "table", "write_shared"]
