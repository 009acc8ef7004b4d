"""Word lists, lookup tables and line patterns that results depend on.

Every operator takes these as parameters; the values here are the defaults.
"""

# Fixed value: the speakers whose words are analysed.
MAIN_SPEAKERS = ["chandler", "ross", "monica", "phoebe", "joey", "rachel"]

# Fixed value: four-letter speaker names and the full names they stand for.
ALIASES = [
    ("chan", "chandler"),
    ("ross", "ross"),
    ("mnca", "monica"),
    ("phoe", "phoebe"),
    ("joey", "joey"),
    ("rach", "rachel"),
]

# Fixed value: names shown in pay reports.
DISPLAY_NAMES = [
    ("chandler", "matthew perry (chandler)"),
    ("ross", "david schwimmer (ross)"),
    ("monica", "courteney cox (monica)"),
    ("rachel", "jennifer aniston (rachel)"),
    ("phoebe", "lisa kudrow (phoebe)"),
    ("joey", "matt leblanc (joey)"),
]

# Fixed value: season, pay per episode, the same adjusted for inflation, episodes.
PAY = [
    ("01", 22500.0, 38325.76, 24.0),
    ("02", 30000.0, 49692.72, 24.0),
    ("03", 75000.0, 120668.74, 25.0),
    ("04", 85000.0, 123690.44, 24.0),
    ("05", 100000.0, 154870.55, 24.0),
    ("06", 125000.0, 189405.01, 25.0),
    ("07", 750000.0, 1099473.00, 24.0),
    ("08", 750000.0, 1069656.78, 24.0),
    ("09", 1000000.0, 1403218.45, 24.0),
    ("10", 1000000.0, 1381951.09, 18.0),
]

# Fixed value: words left out of the distinctive-word lists besides the stop words.
EXTRA_STOP_WORDS = [
    "id", "uh", "ah", "wouldnt", "didnt", "ive", "wasnt", "2", "7", "4", "wont",
    "youre", "hes", "doesnt", "umm", "ill", "theyre", "dont", "ohh", "im", "gonna",
]

# How a cleaned line starts or what it holds decides its type.
SCENE_START, SCENE_ANYWHERE = "[sc", ["(at", "[at"]
ACTION_START, ACTION_ANYWHERE = "(", ["<"]
WRITTEN_START = "written"

# Parameters of the reports.
MIN_PARAGRAPHS = 20
BUCKET_LINES = 30
TOP_WORDS = 30
TOP_SPEAKERS = 30
SPEAKER_QUANTILE = 0.95
