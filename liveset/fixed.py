"""Fixed values.

Word lists, labels, patterns and formats that must equal the established data for
results to agree. They are data, not logic; every operator takes them as defaults
and accepts replacements.
"""

# -- labels -------------------------------------------------------------------
ARTIST = "Grateful Dead"
SHOW_URL_PREFIX = "https://archive.org/details/"
POST_URL_PREFIX = "https://reddit.com"
THREAD_URL_PREFIX = "https://www.reddit.com"
ANONYMOUS = "anonymous"
UNKNOWN_VENUE = "Unknown venue"

# -- review relevance ---------------------------------------------------------
RELEVANT_KEYWORDS = [
    "song", "jam", "play", "show", "set", "music", "sound",
    "experience", "played", "grateful", "dead", "band",
    "performance", "version", "transition", "segue",
    "audience", "crowd", "venue", "atmosphere",
    "dark star", "turn on", "estimated", "eyes", "truckin",
    "bertha", "terrapin", "china cat", "morning dew",
    "good lovin", "uncle john", "sugar magnolia",
]
MIN_RELEVANT_LENGTH = 10

# -- audio files --------------------------------------------------------------
AUDIO_FORMATS = ["FLAC", "VBR MP3", "Ogg Vorbis", "Shorten", "WAV", "MP3"]
TRACK_FORMATS = ["VBR MP3", "FLAC", "Ogg Vorbis"]
NON_AUDIO_SUFFIXES = [".txt", ".torrent"]

NON_SONG_PHRASES = [
    "tuning", "comment", "crowd noise", "applause", "banter",
    "announcement", "speech", "fade in", "fade out",
]
NON_SONG_TRACKS = [
    "tuning", "announcement", "crowd", "intro", "outro", "banter",
    "speech", "comment", "applause", "noise", "misc", "idling",
    "equipment problems", "fade in", "fade out", "silence",
]
SKIP_PHRASES = [
    "comment", "crew", "sound", "light", "stage", "monitors",
    "other artist", "guests", "guest", "band", "members",
    "jerry garcia", "bob weir", "phil lesh", "bill kreutzmann",
    "mickey hart", "keith godchaux", "donna jean", "ronn cuomo",
    "donna godchaux", "vocals", "guitar", "bass", "drums", "keyboards",
    "misc", "tune", "banter", "announcement", "speech",
]
POSITIONAL_MIN_SECONDS = 120
BY_TITLE = "ia_title_match"
BY_LISTING_NUMBER, BY_LISTING_PLACE = "deadtracks_direct", "deadtracks_positional"
BY_PLACE, BY_LONG_PLACE = "positional_fallback", "positional_filtered"

# -- setlists -----------------------------------------------------------------
SET_MARKER = r"Set\s*[0-9]|Set\s*One|Set\s*Two|Set\s*Three|Disc\s*\d|Segue\s*\d"
ENCORE_MARKER = r"Encore\s*[0-9]?"
CREDIT_LINE_START = r"Other artist|Notes:|Source|Soundline|MMA|Recorded|Transfer"
MARKER_START = r"Set|Disc|Encore"
LEGACY_MARKER = r"(Set\s+[IVX]+|Disc\s+\d+|Encore)"
MUSICIAN_WORDS = ["guitar", "bass", "drums", "keyboards"]
LEGACY_DEFAULT_SET = "Set I"
KNOWN_TITLES = [
    "turn on your lovelight", "estimated prophet", "scarlet begonias",
    "sugar magnolia", "morning dew", "casey jones", "mama tried",
    "high time", "easy wind", "yellow dog story", "dark star",
    "saint stephen", "the eleven", "truckin", "good lovin",
    "playing in the band", "wharf rat", "me and my uncle",
    "friend of the devil", "big railroad", "cumberland gorge",
    "me and bobby magee", "row jimmy", "brokedown servants",
    "greatest story ever", "terrapin station", "the other one",
    "stella blue", "help on the way", "slipknot", "franklin tower",
    "promised land", "black peter", "one more saturday night",
    "lost sailor", "st of cdc", "china cat sunflower",
    "i know you rider", "around here", "space", "drumz",
    "one more saturday", "sugar", "bertha", "sunshine",
    "eyes", "wheel",
]

# -- song names ---------------------------------------------------------------
SONG_ALIASES = {
    "minglewood blues": "new minglewood blues",
    "women are smarter": "man smart woman smarter",
    "woman are smarter": "man smart woman smarter",
    "man smart": "man smart woman smarter",
    "sunshine daydream": "sunshine daydream",
    "c c rider": "cc rider",
    "big boss man": "big boss man",
    "going down the road feeling bad": "go down road feeling bad",
    "i ko i ko": "iko iko",
}
CREDIT_PATTERN = (
    r"^[A-Z][\w\.'\- ]{0,30}\s*-\s*(Guitar|Drums|Bass|Keyboards?|Vocals?|Piano|"
    r"Organ|Harmonica|Sax(ophone)?|Percussion|Trombone|Trumpet|Fiddle|Violin|"
    r"Mandolin|Banjo|Squeezebox)\b"
)
NOISE_PATTERN = (
    r"(other artist|weir on|acoustic guitar|\(\d+ mins|^\(set |^set [12]\b|^encore$|"
    r"^soundcheck|tuning|tease|splice|^missing |last played|first live|^\(unknown|"
    r"^\(late show|http|\.com|^\w\d+t\d+$|^[-=*#_%$'\"]{2,}|^\+|^\^\^?|^\.\.|^//|"
    r"^comment\b|^banter\b|^crowd\b|^applause\b|^chatter\b|^intro\b|^outro\b|"
    r"^jam\b|^drums\b|^space\b|^feedback\b|^tuning\b|^dead air\b|^talk\b)"
)
SONG_NAME_LENGTHS = (2, 60)
FUZZY_CUTOFF = 0.9
DISCUSSION_WORDS = ["song discussion", "official", "discussion"]
MIN_MENTION_KEY = 4
POSTS_PER_SONG = 5
POST_TEXT_CAP = 600

# -- dates --------------------------------------------------------------------
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3,
    "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9,
    "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
NUMBER_WORDS = {
    "one": 1, "first": 1, "two": 2, "second": 2, "three": 3, "third": 3,
    "four": 4, "fourth": 4, "five": 5, "fifth": 5, "six": 6, "sixth": 6,
    "seven": 7, "seventh": 7, "eight": 8, "eighth": 8, "nine": 9, "ninth": 9,
    "ten": 10, "tenth": 10, "eleven": 11, "eleventh": 11, "twelve": 12,
    "twelfth": 12, "thirteen": 13, "thirteenth": 13, "fourteen": 14,
    "fourteenth": 14, "fifteen": 15, "fifteenth": 15, "sixteen": 16,
    "sixteenth": 16, "seventeen": 17, "seventeenth": 17, "eighteen": 18,
    "eighteenth": 18, "nineteen": 19, "nineteenth": 19, "twenty": 20,
    "twentieth": 20, "thirty": 30, "thirtieth": 30,
}
CENTURY_PIVOT = 30

KNOWN_VENUES = {
    "1978-09-02": "Red Rocks Amphitheatre, Morrison, CO",
    "1984-04-13": "Crisler Arena, Ann Arbor, MI",
    "1985-11-11": "Cope Arena, Orlando, FL",
    "1982-07-25": "Oakland Coliseum, Oakland, CA",
    "1978-01-30": "Shrine Auditorium, Los Angeles, CA",
    "1980-12-31": "San Francisco Civic Center, San Francisco, CA",
    "1983-04-13": "Broome County Veterans Memorial Arena, Binghamton, NY",
    "1977-03-18": "Winterland Arena, San Francisco, CA",
    "1985-08-31": "Universal Amphitheatre, Los Angeles, CA",
    "1977-05-07": "Boston Garden, Boston, MA",
    "1977-05-08": "Boston Garden, Boston, MA",
    "1977-05-09": "Boston Garden, Boston, MA",
    "1977-05-17": "Hollywood Palladium, Los Angeles, CA",
}

# -- forum --------------------------------------------------------------------
POST_LABELS = {
    "setlist": ["setlist", "set list", "what did they play"],
    "review": ["review", "thoughts", "discussion"],
    "song": ["song", "track", "favorite"],
}
POST_DATE_PATTERNS = [
    r"gd\d{4}-\d{2}-\d{2}",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\d{1,2}/\d{1,2}/\d{4}",
]
POST_BODY_CAP = 5000
REPLY_BODY_CAP = 2000
DISCUSSION_BODY_CAP = 4000
REPLY_MAX_DEPTH = 3
REPLY_CAP = 50

# -- questions ----------------------------------------------------------------
ACTIONS = ["ask", "search", "lyrics", "meaning"]
COMMAND_PREFIX = "!gd"
ROUTES = ["song", "guest", "transition", "deadcast", "ep"]
DIGEST_PROMPTS = [
    "best performance ever played",
    "best version I ever heard",
    "this show is amazing",
    "unforgettable",
]

# -- pages --------------------------------------------------------------------
BOILERPLATE_PATTERN = (
    r"(get on the list|sign ?up|newsletter|subscribe|cookie|privacy policy|"
    r"tapers section|all the years live|jam of the week|comix by)"
)
TRANSCRIPT_CLASSES = [
    "field-name-field-transcript", "transcript", "episode-transcript",
]
TRANSCRIPT_IDS = ["transcript-content"]
EPISODE_LINK_PATTERN = r"/episodes/|/deadcast/|(?i:episode)"
LYRIC_END = r"\nNotes\n|\nGrateful Dead Recordings\b|\nFor more information\b|\nFurther Information\b|\nDiscograph"
NOTES_END = r"\nGrateful Dead Recordings\b|\nFor more information\b|\nFurther Information\b|\nHome\n\|"
INSTRUMENTAL_LABELS = ["(instrumental)", "Instrumental", "instrumental"]
SOURCE_FIELDS, SOURCE_PLAIN, SOURCE_FORUM = "dead.net-notes", "whitegum-notes", "reddit"
HOOK_FIELDS = "pending-deadnet-browser-fetch"
HOOK_FORUM = "pending-reddit-fetch (HTTP 403)"

# -- song names ---------------------------------------------------------------
# Pattern and replacement, in the order that defines the result.
SONG_KEY_STEPS = [
    (r"^\s*(?:e\d*|encore|set\s*(?:i{1,3}|\d)|1st set|2nd set|\d+)\s*[:\-.]\s*", ""),
    (r"^\s*\([^)]*\)\s*", ""),
    (r"\bgrey\b", "gray"),
    (r"\bplayin\b", "playing"),
    (r"\bnfa\b", "not fade away"),
    (r"\bwrs\b", "weather report suite"),
    (r"\bthe\b", " "),
    (r"[^a-z0-9]+", " "),
]
TITLE_CODES = [
    (r"\[\d{1,2}:\d{2}(?:\.\d+)?\]", " "),
    (r"(?i)^\s*d\d+t\d+[\s:. -]*", " "),
    (r"^\d{1,2}:\d{2}(?:\.\d+)?\s*", " "),
]
TITLE_BULLETS = [
    ("^[*#$%\\-–—]+\\s*", ""),
    (r"^\(\d+\)\s*", ""),
    (r"^\d+[.:\-]?\s+", ""),
]
TITLE_ENDS = [
    (r"(?i)\s*\(note \d+\)\s*$", ""),
    (r"\s*(?:&gt;|>|->|,)+\s*$", ""),
]

# -- graph --------------------------------------------------------------------
DEPTH_COLOURS = [
    "lightblue", "lightgreen", "lightyellow", "lightcoral", "lightpink",
    "lightgray", "lightsalmon", "lightseagreen", "lightsteelblue",
    "lightgoldenrodyellow",
]

# -- review queue -------------------------------------------------------------
STATUS_ORDER = {"pending": 0, "approved": 1, "rejected": 2}
PAGE_SIZE = 10

# -- corpus -------------------------------------------------------------------
CHUNK_WORDS = 500
CORPUS_TYPES = [
    "comment", "setlist_song", "guest_artist", "transition",
    "deadcast_transcript", "ep_duration", "lyric", "interpretation",
]

# -- projections --------------------------------------------------------------
COLLECTION_ITEMS = 18327
DEFAULT_COMMENTS_PER_SHOW = 5
BYTES_PER_COMMENT = 100
BYTES_PER_SETLIST = 500
SECONDS_PER_SHOW = 3.25
