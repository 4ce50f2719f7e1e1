"""Code tables and word lists of the jobs.

Fixed values: they must equal the published data's codes for right results.
"""

# Counties of the city by state-and-county code.
CITY_COUNTIES = {
    "36061": "New York",
    "36047": "Kings",
    "36005": "Bronx",
    "36081": "Queens",
    "36085": "Richmond",
}

# Borough codes by county name and by three-digit county code.
BOROCODE_BY_COUNTY = {"New York": 1, "Bronx": 2, "Kings": 3, "Queens": 4, "Richmond": 5}
BOROCODE_BY_COUNTY_CODE = {"061": 1, "005": 2, "047": 3, "081": 4, "085": 5}

# Boroughs by letter.
BOROUGH_BY_LETTER = {
    "M": "Manhattan",
    "X": "Bronx",
    "K": "Brooklyn",
    "Q": "Queens",
    "R": "Staten Island",
}

# Boroughs by school district.
BOROUGH_BY_DISTRICT = [
    (1, 6, "Manhattan"),
    (7, 12, "Bronx"),
    (13, 23, "Brooklyn"),
    (32, 32, "Brooklyn"),
    (24, 30, "Queens"),
    (31, 31, "Staten Island"),
]

# Means of travel to work, as variable names and as published labels.
TRAVEL_VARIABLES = {
    "1": "trans_total",
    "2": "trans_auto_solo",
    "3": "trans_auto_2",
    "4": "trans_auto_3",
    "5": "trans_auto_4",
    "6": "trans_auto_5_or_6",
    "7": "trans_auto_7_or_more",
    "8": "trans_public_bus",
    "9": "trans_public_streetcar",
    "10": "trans_public_subway",
    "11": "trans_public_rail",
    "12": "trans_public_ferry",
    "13": "trans_bicycle",
    "14": "trans_walk",
    "15": "trans_taxi",
    "16": "trans_motorcycle",
    "17": "trans_other",
    "18": "trans_home",
}
CARPOOL = ["trans_auto_2", "trans_auto_3", "trans_auto_4", "trans_auto_5_or_6", "trans_auto_7_or_more"]
AUTO = ["trans_auto_solo", *CARPOOL]
PUBLIC = [
    "trans_public_bus",
    "trans_public_streetcar",
    "trans_public_subway",
    "trans_public_rail",
    "trans_public_ferry",
]
TRAVEL_LABELS = {
    "1": "Total",
    "2": "Car, truck, or van -- Drove alone",
    "3": "Car, truck, or van -- In a 2-person carpool",
    "4": "Car, truck, or van -- In a 3-person carpool",
    "5": "Car, truck, or van -- In a 4-person carpool",
    "6": "Car, truck, or van -- In a 5-or-6-person carpool",
    "7": "Car, truck, or van -- In a 7-or-more-person carpool",
    "8": "Bus or trolley bus",
    "9": "Streetcar or trolley car",
    "10": "Subway or elevated",
    "11": "Railroad",
    "12": "Ferryboat",
    "13": "Bicycle",
    "14": "Walked",
    "15": "Taxicab",
    "16": "Motorcycle",
    "17": "Other method",
    "18": "Worked at home",
}

# The 31 counties whose workplaces are kept.
WORKPLACE_COUNTIES = [
    "09001", "09005", "09009",
    "34003", "34013", "34017", "34019", "34021", "34023", "34025", "34027",
    "34029", "34031", "34035", "34037", "34039", "34041",
    "36005", "36027", "36047", "36059", "36061", "36071", "36079", "36081",
    "36085", "36087", "36103", "36105", "36111", "36119",
]

# Grades by school level.
HIGH_SCHOOL_GRADES = ["9", "10", "11", "12"]
PRIMARY_GRADES = ["PK", "K", "1", "2", "3", "4", "5"]
MIDDLE_GRADES = ["6", "7", "8"]

# School level from the school's name: the first text contained decides, then
# the first whole word.
LEVEL_CONTAINED = [
    ("3K", "3K"),
    ("PRE-K", "PK"),
    ("P.S./I.S.", "PSIS"),
    ("P.S.", "PS"),
    ("I.S.", "IS"),
    ("M.S.", "IS"),
    ("H.S.", "HS"),
    ("HIGH SCHOOL", "HS"),
]
# The project list knows three more, and combined levels are read without spaces.
LEVEL_CONTAINED_PREFIX = [("3K", "3K"), ("PRE-K", "PK")]
LEVEL_CONTAINED_SPACELESS = [("P.S./I.S.", "PSIS"), ("I.S./H.S.", "ISHS"), ("P.S./H.S.", "PSHS")]
LEVEL_CONTAINED_REST = [
    ("P.S.", "PS"),
    ("I.S.", "IS"),
    ("M.S.", "IS"),
    ("H.S.", "HS"),
    ("HIGH SCHOOL", "HS"),
    ("D75", "SE"),
]
LEVEL_WORDS = [("PS", "PS"), ("IS", "IS"), ("HS", "HS")]

# Share of seats by school level.
PROJECT_SHARES = {
    "pct_ps": {"PS": 1.0, "PSIS": 0.5, "PSHS": 0.5},
    "pct_is": {"IS": 1.0, "PSIS": 0.5, "ISHS": 0.5},
    "pct_hs": {"HS": 1.0, "PSHS": 0.5, "ISHS": 0.5},
}
CAPITAL_SHARES = {
    "pct_ps": {"PS": 1.0, "PSIS": 0.5},
    "pct_is": {"IS": 1.0, "PSIS": 0.5},
    "pct_hs": {"HS": 1.0},
}

# Schools left out of the building list, by reason.
COMPETITIVE_HIGH_SCHOOLS = ["X445", "K449", "K430", "M692", "X696", "Q687", "R605", "M475"]
GIFTED_SCHOOLS = ["M539", "M334", "K686", "Q300", "M012", "M485"]
RESTART_SCHOOLS = ["M973", "Q950"]
OTHER_SCHOOLS = ["X695", "M645"]

# Registrations that are no boiler permits of interest.
REGISTRATION_TYPES = ["REGISTRATION", "REGISTRATION INSPECTION", "BOILER REGISTRATION II"]

# Proposals before this day belong to no published meeting.
FIRST_MEETING_DAY = "2016-04-21"

# Where permit pages live, and the link text that is no permit.
PERMIT_URL_PREFIX = "http://www.dec.ny.gov/dardata/boss/afs/"
REVIEW_REPORT = "PRR"
