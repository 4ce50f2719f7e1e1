"""Jobs that publish a geometry table as it is."""

from __future__ import annotations

from civicflow.plans import schemas
from civicflow.plans.job import Frames, JobSpec


def passthrough_job(name: str, ddl: str) -> JobSpec:
    """Declared columns of one table; undeclared ones are dropped."""

    def build(inputs: Frames) -> Frames:
        return {name: inputs[name]}

    return JobSpec(name, [name], {name: ddl}, build)


AREAS_OF_CONCERN = passthrough_job("areas_of_concern", schemas.AREAS_OF_CONCERN)
TRAFFIC_CAMERAS = passthrough_job("traffic_cameras", schemas.TRAFFIC_CAMERAS)
AADT = passthrough_job("aadt", schemas.AADT)
VENTILATION_TOWERS = passthrough_job("tunnel_ventilation_towers", schemas.VENTILATION_TOWERS)
