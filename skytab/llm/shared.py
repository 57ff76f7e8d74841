"""Lineage cuts, as the library has them."""

from ..checkpoints import cut, scratch, shared_dir

__all__ = ["cut", "scratch", "shared_dir"]
