"""Import every query module so the registry is complete."""

from pagefleet.plans import route_queries  # noqa: F401
from pagefleet.plans import candidate_queries  # noqa: F401
from pagefleet.plans import fleet_queries  # noqa: F401
from pagefleet.plans import page_queries  # noqa: F401
from pagefleet.plans import agent_queries  # noqa: F401
from pagefleet.plans import stream_queries  # noqa: F401
from pagefleet.plans import stage_queries  # noqa: F401
from pagefleet.plans import hostile_queries  # noqa: F401
from pagefleet.plans import ledger_queries  # noqa: F401
from pagefleet.plans import detail_queries  # noqa: F401
