"""Fixed values of the data formats and of the published answers."""

# Head keys of the timetable feed.
KIND_ASSOCIATION = "JsonAssociationV1"
KIND_SCHEDULE = "JsonScheduleV1"
KIND_TIPLOC = "TiplocV1"
KIND_HEADER = "JsonTimetableV1"
KIND_END = "EOF"

# Movement feed message types.
MSG_ACTIVATION = "0001"
MSG_CANCELLATION = "0002"
MSG_MOVEMENT = "0003"
MSG_CHANGE_OF_ORIGIN = "0006"

# Enumerations.
TRANSACTION_TYPES = ["Create", "Update", "Delete"]
STP_INDICATORS = ["C", "N", "O", "P"]
STP_PERMANENT = "P"
ASSOCIATION_JOIN = "JJ"
ASSOCIATION_DIVIDE = "VV"
ASSOCIATION_NEXT = "NP"
ASSOCIATION_CATEGORIES = [ASSOCIATION_JOIN, ASSOCIATION_DIVIDE, ASSOCIATION_NEXT]
LOCATION_TYPES = ["LO", "LT", "LI"]
EVENT_TYPES = ["DEPARTURE", "ARRIVAL"]
VARIATION_STATUSES = ["ON TIME", "EARLY", "LATE", "OFF ROUTE"]
CANCELLATION_TYPES = ["ON CALL", "AT ORIGIN", "EN ROUTE", "OUT OF PLAN"]
WEEKDAYS = "Weekdays"
SATURDAYS = "Saturdays"
SUNDAYS = "Sundays"
DAY_COLUMNS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
RECORD_PRIMARY = "Primary"
RECORD_SECONDARY = "Secondary"
UNKNOWN_CRS = "N/A"

# Notification subjects.
SUBJECT_MOVEMENT = "Train Delay Helper: Delay Update"
SUBJECT_CANCELLATION = "Train Delay Helper: Cancel Update"
SUBJECT_CHANGE_OF_ORIGIN = "Train Delay Helper: Change of Origin Update"

# Operator code -> operator name.
OPERATOR_NAMES = {
    "AR": "Alliance Rail",
    "NT": "Arriva Trains Northern",
    "AW": "Arriva Trains Wales",
    "CC": "c2c",
    "CS": "Caledonian Sleeper",
    "CH": "Chiltern Railway",
    "XC": "CrossCountry",
    "EM": "East Midlands Trains",
    "ES": "Eurostar",
    "HT": "First Hull Trains",
    "GX": "Gatwick Express",
    "ZZ": "GB Railfreight",
    "GN": "Govia Thameslink Railway (Great Northern)",
    "TL": "Govia Thameslink Railway (Thameslink)",
    "GC": "Grand Central",
    "LN": "Great North Western Railway",
    "GW": "Great Western Railway",
    "LE": "Greater Anglia",
    "HC": "Heathrow Connect",
    "HX": "Heathrow Express",
    "IL": "Island Lines",
    "LS": "Locomotive Services",
    "LM": "London Midland",
    "LO": "London Overground",
    "LT": "London Underground",
    "ME": "Merseyrail",
    "TW": "Nexus (Tyne & Wear Metro)",
    "NY": "North Yorkshire Moors Railway",
    "SR": "ScotRail",
    "SW": "South Western Railway",
    "SJ": "South Yorkshire Supertram",
    "SE": "Southeastern",
    "SN": "Southern",
    "SP": "Swanage Railway",
    "XR": "TfL Rail",
    "TP": "TransPennine Express",
    "VT": "Virgin Trains",
    "GR": "Virgin Trains East Coast",
    "WR": "West Coast Railway Co.",
}

# Fixed values: (stanox, tiploc) pairs whose tiploc is the main entry of the stanox.
PREFERRED_TIPLOCS = [
    ("86935", "POOLE"),
    ("88486", "SWLY"),
    ("89428", "ASHFKY"),
    ("86441", "BOGNORR"),
    ("87981", "BRGHMHS"),
    ("40320", "CHST"),
    ("87219", "CLPHMJN"),
    ("89530", "EBSFDOM"),
    ("87071", "EFNGHMJ"),
    ("01100", "IVRNESS"),
    ("31510", "MNCRVIC"),
    ("30120", "PRST"),
    ("52215", "STFORDI"),
    ("87201", "VICTRIA"),
    ("86981", "WEYMTH"),
    ("87261", "WIMBLDN"),
    ("72277", "WLSDNJL"),
    ("86037", "WOKICHS"),
    ("82341", "YOVILJN"),
]

# Defaults of the job parameters.
LATE_THRESHOLD_MS = 15 * 60 * 1000
ACTIVATION_TTL_MS = 3 * 24 * 3600 * 1000
#: Groups that the records of one train are dealt over when they meet its activations.
DEFAULT_SALTS = 4
HISTORY_LOOKBACK_MS = 30 * 24 * 3600 * 1000
MIN_SCHEDULE_DAYS = 2
