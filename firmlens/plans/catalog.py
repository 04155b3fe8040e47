"""All queries and their checking SQL."""
from firmlens.plans.registry import ORACLES, QUERIES  # noqa: F401
from firmlens.plans import abuse, batches, companies, extraction, privacy, search, streams, telemetry, validation  # noqa: F401
