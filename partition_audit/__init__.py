"""Checking, comparing and maintaining large partitioned tables on Spark."""

from partition_audit.operators import *  # noqa: F403
from partition_audit.operators import __all__ as _operators
from partition_audit.plans import *  # noqa: F403
from partition_audit.plans import __all__ as _jobs
from partition_audit.session import build_session
from partition_audit.sources import *  # noqa: F403
from partition_audit.sources import __all__ as _sources

__all__ = [*_operators, *_jobs, *_sources, "build_session"]
