"""threadlens: discussion-thread and text-corpus analytics as Spark DataFrame plans."""

from threadlens.session import get_session, ensure_checkpoint_dir, scratch_path

__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path"]
