"""Every registered query: importing this module loads all query groups
(in dependency order) into ``REGISTRY``."""

from __future__ import annotations

from inkwell.plans import registry
from inkwell.plans import q_quality, q_dashboards, q_recommend, q_forecast  # noqa: F401
from inkwell.plans import q_content, q_streaming, q_extras, q_maintained  # noqa: F401

REGISTRY = registry.REGISTRY
