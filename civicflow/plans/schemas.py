"""Output schemas of the jobs.

Fixed values: column names, order and types are those the published tables must
have, one ``name type`` a line.
"""

ATYPICAL_ROADWAYS = """
streetname text
segmentid text
streetwidth_min text
streetwidth_max text
right_zipcode text
left_zipcode text
borocode integer
nodelevelf text
nodelevelt text
featuretyp text
trafdir text
number_total_lanes text
bikelane text
geom geometry(LineString,4326)
"""

SCHOOL_BUILDINGS = """
district integer
subdistrict integer
borocode integer
bldg_name character varying
excluded boolean
bldg_id character varying
org_id character varying
org_level character varying
name character varying
address character varying
pc integer
pe integer
ic integer
ie integer
hc integer
he integer
geom geometry(Point,4326)
"""

CENSUSTRACT_CENTROIDS = """
geoid character varying
geom geometry(Point,4326)
"""

CENSUSTRACT_VARIABLES = """
geoid character varying
value integer
moe integer
variable character varying
"""

JOURNEY_TO_WORK = """
residential_geoid character varying
work_geoid character varying
MODE character varying
count integer
standard_error double precision
"""

AREAS_OF_CONCERN = """
name text
geom geometry(MultiPolygon,4326)
"""

CATS_PERMITS = """
requestid text
applicationid text
requesttype text
ownername text
expiration_date date
make text
model text
burnermake text
burnermodel text
primaryfuel text
secondaryfuel text
quantity text
issue_date date
status text
premisename text
housenum text
streetname text
address text
streetname_1 text
streetname_2 text
borough text
geo_housenum text
geo_streetname text
geo_address text
geo_bbl bigint
geo_bin text
geo_latitude double precision
geo_longitude double precision
geo_x_coord double precision
geo_y_coord double precision
geo_function text
geom geometry(Point,4326)
"""

CATS_PERMITS_REJECTS = """
requestid text
applicationid text
requesttype text
ownername text
expiration_date date
make text
model text
burnermake text
burnermodel text
primaryfuel text
secondaryfuel text
quantity text
issue_date date
status text
premisename text
housenum text
streetname text
address text
streetname_1 text
streetname_2 text
borough text
geo_housenum text
geo_streetname text
geo_address text
geo_bbl bigint
geo_bin text
geo_latitude double precision
geo_longitude double precision
geo_x_coord double precision
geo_y_coord double precision
geom geometry(Point,4326)
geo_function text
geo_grc text
geo_grc2 text
geo_reason_code text
geo_message text
"""

UTILIZATION_CHANGES = """
bldg_id text
org_id text
bldg_id_additional text
title text
at_scale_year text
url text
at_scale_enroll integer
vote_date date
"""

MEETING_URLS = """
url text
school_year text
readable_url text
date text
"""

TRAFFIC_CAMERAS = """
content text
icon text
id text
latitude double precision
longitude double precision
title text
url text
geom geometry(Point,4326)
"""

FACILITIES_GARAGES = """
facname text
geo_housenum text
geo_streetname text
geo_address text
city text
zipcode text
borough text
borocode integer
geo_bin text
geo_bbl bigint
geo_commboard text
geo_nta text
geo_council text
geo_schooldist text
geo_policeprct text
geo_censtract text
factype text
facsubgrp text
facgroup text
facdomain text
servarea text
opname text
opabbrev text
optype text
overagency text
overabbrev text
overlevel text
capacity text
captype text
proptype text
geo_latitude double precision
geo_longitude double precision
geo_xcoord double precision
geo_ycoord double precision
datasource text
uid text
geom geometry(Point,4326)
"""

AIR_MONITORING_STATIONS = """
site_id text
monitor_type text
borocode integer
county text
site_name text
air_quality_system_id text
latitude double precision
longitude double precision
ozone text
so2 text
nox text
co text
pm_2.5 text
cpm_2.5 text
pm_10 text
cpm_10 text
lead text
speciation text
continuous_speciation text
metals text
toxics text
carbonyls text
acid_rain text
pams text
mercury text
location text
geom geometry(Point,4326)
"""

FACILITY_PERMITS = """
facility_name text
permit_id text
url_to_permit_text text
facility_location text
address text
housenum text
streetname text
streetname_1 text
streetname_2 text
facility_city text
facility_state text
borough text
zipcode text
issue_date date
expiration_date date
location text
geo_housenum text
geo_streetname text
geo_address text
geo_bbl bigint
geo_bin text
geo_latitude double precision
geo_longitude double precision
geo_x_coord double precision
geo_y_coord double precision
geo_function text
geom geometry(Point,4326)
"""

# Rejected permits and projects carry the reason on top.
REJECT_REASON = """
geo_grc text
geo_grc2 text
geo_reason_code text
geo_message text
"""

FACILITY_PERMITS_REJECTS = FACILITY_PERMITS + REJECT_REASON.lstrip()

AADT = """
enddesc text
muni text
tdv_route text
aadt_year text
data_type text
vol_txt text
class_txt text
speed_txt text
vol_tdv text
class_tdv text
speed_tdv text
shape.stlength() double precision
rc_id text
loc_error text
objectid integer
aadt integer
objectid_1 integer
ccst text
begdesc text
fc text
perc_truck double precision
count_type text
su_aadt integer
cu_aadt integer
countyr text
aadt_last_ integer
gis_id text
firstofbeg double precision
lastofend_ double precision
geom geometry(MultiLineString,4326)
"""

FUNCTIONAL_CLASS = """
objectid integer
route_no text
func_class integer
segment_name text
unique_id integer
roadway_type double precision
co_rd_no text
access_control double precision
bridge_feature_number text
hpms_sample_id double precision
jurisdiction text
last_actual_cntyr double precision
median_type text
mpo text
municipality_type text
borough text
owning_juris text
ramp_dest_co_order double precision
ramp_orig_co_order double precision
shoulder_type text
strahnet text
surface_type double precision
tandem_truck double precision
toll text
urban_area_code text
owned_by_muni_type text
from_date text
to_date text
locerror text
shape.stlength() double precision
signing text
geom geometry(MultiLineString,4326)
"""

TRAFFIC_COUNTS = """
rc_station text
count_stats_id text
rg text
region_code text
borocode integer
county_code text
cou text
stat text
rcsta text
ccst text
fc text
fg text
federal_direction text
f text
o text
calculation_year text
a text
aadt text
dhv text
ddhv text
su_aadt text
cu_aadt text
year_last_act text
aadt_last_act text
k_factor text
d_factor text
year_2last_act text
aadt_2last_act text
year_3last_act text
aadt_3last_act text
year_4last_act text
aadt_4last_act text
class_count_yr text
avg_wkday_f3_13 text
act_avg_truck_perc text
act_avg_su_perc text
act_avg_cu_perc text
act_avg_mc_perc text
act_avg_car_perc text
act_avg_lt_perc text
act_avg_bus_perc text
avg_wkday_f5_7 text
axle_factor text
su_peak text
cu_peak text
class_est_yr text
est_rg_fc_su text
est_rg_fc_cu text
est_rg_fc_truck text
est_rg_fc_su_peak text
est_rg_fc_cu_peak text
est_rg_fc_axle_factr text
est_fc_su text
est_fc_cu text
est_fc_truck text
est_fc_su_peak text
est_fc_cu_peak text
est_fc_axle_factr text
speed_count_yr text
speed_limit text
avg_speed text
perc_speed_50 text
perc_speed_85 text
exceeding_55 text
exceeding_65 text
avg_k_factor text
avg_d_factor text
dd_id text
geom geometry(MultiLineString,4326)
"""

CAPACITY_PROJECTS = """
uid text
name text
org_level text
district text
capacity bigint
pct_ps double precision
pct_is double precision
pct_hs double precision
guessed_pct boolean
start_date date
capital_plan text
borough text
address text
geo_function text
geom geometry
"""

CAPACITY_PROJECTS_REJECTS = CAPACITY_PROJECTS + REJECT_REASON.lstrip()

# The declared point column of this table is never built, so it is not listed.
CAPITAL_PROJECTS = """
project_dsf text
name text
org_level text
capacity bigint
pct_ps double precision
pct_is double precision
pct_hs double precision
guessed_pct boolean
start_date date
planned_end_date date
total_est_cost double precision
funding_current_budget double precision
funding_previous double precision
pct_funded double precision
"""

PROJECTIONS_BY_BORO = """
year integer
borough character varying
hs integer
"""

PROJECTIONS_BY_SD = """
school_year integer
district integer
subdistrict integer
ps integer
is integer
"""

VENTILATION_TOWERS = """
name text
address text
link text
geom geometry(Point,4326)
"""
