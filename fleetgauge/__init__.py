"""Fleet health analytics as Spark jobs."""

from fleetgauge.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
