"""Operations analytics on Spark: logs, metrics, health, alerts, inventory, lifecycle, access and configuration."""

from tidewatch.session import build_session, materialize, scratch_dir

__all__ = ["build_session", "materialize", "scratch_dir"]
