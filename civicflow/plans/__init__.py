"""Ready-made jobs composed from the operators."""

from civicflow.plans.capacity import CAPACITY_PROJECTS, CAPITAL_PROJECTS
from civicflow.plans.commuting import CENTROIDS, JOURNEY_TO_WORK, VARIABLES
from civicflow.plans.enrolment import PROJECTIONS_BY_BORO, PROJECTIONS_BY_SD
from civicflow.plans.facilities import AIR_STATIONS, GARAGES
from civicflow.plans.job import JobSpec
from civicflow.plans.passthrough import AADT, AREAS_OF_CONCERN, TRAFFIC_CAMERAS, VENTILATION_TOWERS
from civicflow.plans.permits import BOILER_PERMITS, STATE_PERMITS, TITLE_V_PERMITS
from civicflow.plans.roads import ATYPICAL_ROADWAYS, FUNCTIONAL_CLASS, TRAFFIC_COUNTS
from civicflow.plans.schools import SCHOOL_BUILDINGS
from civicflow.plans.utilization import MEETING_URLS, UTILIZATION_CHANGES

JOBS: dict[str, JobSpec] = {
    job.name: job
    for job in [
        ATYPICAL_ROADWAYS,
        SCHOOL_BUILDINGS,
        CENTROIDS,
        VARIABLES,
        JOURNEY_TO_WORK,
        AREAS_OF_CONCERN,
        BOILER_PERMITS,
        MEETING_URLS,
        UTILIZATION_CHANGES,
        TRAFFIC_CAMERAS,
        GARAGES,
        AIR_STATIONS,
        STATE_PERMITS,
        TITLE_V_PERMITS,
        AADT,
        FUNCTIONAL_CLASS,
        TRAFFIC_COUNTS,
        CAPACITY_PROJECTS,
        CAPITAL_PROJECTS,
        PROJECTIONS_BY_BORO,
        PROJECTIONS_BY_SD,
        VENTILATION_TOWERS,
    ]
}
