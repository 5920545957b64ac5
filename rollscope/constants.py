"""Fixed values of the domain: label orders, weights, sentinels."""

# The short column names of the 31 states in corpus order.
STATE_COLUMNS = [
    "andaman", "andhra", "arunachal", "assam", "bihar", "chandigarh", "dadra", "daman", "delhi", "goa", "guj", "har",
    "jha", "jk", "kar", "kerala", "maharashtra", "manipur", "meghalaya", "mizoram", "mp", "nagaland", "odi",
    "puducherry", "punjab", "rajasthan", "sikkim", "tel", "tripura", "up", "utt",
]

# The 37 languages; the order breaks ties.
LANG_ORDER = [
    "sindhi", "nepali", "kannada", "marathi", "mizo", "adi", "garo", "tagin", "assamese", "hindi", "odia", "french",
    "punjabi", "naga languages", "english", "chenchu", "urdu", "bengali", "maithili", "dogri", "kokborok", "santali",
    "kashmiri", "gujarati", "apatani", "tulu", "konkani", "telugu", "malayalam", "tamil", "meitei", "khasi", "gondi",
    "bodo", "nishi", "chakma", "pahari and kumauni",
]

# Weights of the first to fourth most spoken language.
LANG_WEIGHTS = [0.5, 0.25, 0.125, 0.125]

# Printed names of abbreviated states.
DISPLAY_NAMES = {
    "Andaman": "Andaman and Nicobar", "Andhra": "Andhra Pradesh", "Arunachal": "Arunachal Pradesh",
    "Guj": "Gujarat", "Har": "Haryana", "Jk": "Jammu and Kashmir", "Jha": "Jharkhand", "Kar": "Karnataka",
    "Mp": "Madhya Pradesh", "Odi": "Odisha", "Tel": "Telengana", "Up": "Uttar Pradesh", "Utt": "Uttaranchal",
}

NO_FIRST, NO_LAST = "FNU", "LNU"
MIN_OCCURRENCE = 3
MIN_LENGTH = 3
MIN_COUNT = 10
EXCLUDED_STATES = ["himachal", "wb", "tn"]
UNREADABLE = "UNREADABLE"
MALE = ["Male", "पुरूष"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
