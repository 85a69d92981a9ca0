"""Rule tables: the fixed vocabulary behind the cleaning and geocoding operators.

Operators take a :class:`Rules` value, so other vocabularies can be supplied;
``MUNICIPAL`` is the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# What stands for an unknown responsibility, dimension and category.
UNKNOWN_RESP = "א.מ.ל"
UNKNOWN_DIM = "לא ידוע"
UNCLASSIFIED = "לא מסווג"

# Location types (fixed values).
LOC_ADDRESS = "כתובת"
LOC_INTERSECTION = "צומת"
LOC_RANGE = "טווח בתים"
LOC_LANDMARK = "ציון דרך"
LOC_NONE = "ללא רחוב"

# Sub-topic, category, substance, asset.
SUBTOPICS = [
    ("אי פינוי אשפה ביתית", "אי פינוי", "אשפה ביתית", "פח"),
    ("אי פינוי גזם", "אי פינוי", "גזם", "לא ידוע"),
    ("אי פינוי מכולה", "אי פינוי", "פסולת גושית", "מכולה"),
    ("גזם עירוני שלא פונה", "אי פינוי", "גזם", "לא ידוע"),
    ("פח אשפה שלא הוחזר", "תלונה על ביצוע הפינוי", "אשפה ביתית", "פח"),
    ("אשפה מפוזרת לאחר פינוי", "תלונה על ביצוע הפינוי", "אשפה ביתית", "רחוב"),
    ("איסוף אשפה בשעה מוקדמת", "תלונה על ביצוע הפינוי", "אשפה ביתית", "לא ידוע"),
    ("רחוב מלוכלך", "משטח מלוכלך", "כללי", "רחוב"),
    ("מדרכה מלוכלכת", "משטח מלוכלך", "כללי", "מדרכה"),
    ("מגרש מלוכלך", "משטח מלוכלך", "כללי", "מגרש"),
    ("ניקיון מקלטים", "משטח מלוכלך", "כללי", "מקלט"),
    ("שירותים ציבוריים", "משטח מלוכלך", "כללי", "שירותים ציבוריים"),
    ("ערמת פסולת", "פסולת לא מורשית", "כללי", "רחוב"),
    ("אשפה מפוזרת", "פסולת לא מורשית", "אשפה ביתית", "רחוב"),
    ("פסולת חריגה - זכוכיות", "פסולת לא מורשית", "זכוכית", "רחוב"),
    ("פסולת חריגה", "פסולת לא מורשית", "פסולת גושית", "רחוב"),
    ("ערמת קרטונים", "פסולת לא מורשית", "קרטונים", "רחוב"),
    ("בור גזם", "פסולת לא מורשית", "גזם", "לא ידוע"),
    ("כלי אצירה פגומים", "כלי אצירה פגומים", "בקשה מהעירייה", "פח"),
    ("תקלה בטמוני קרקע", "כלי אצירה פגומים", "בקשה מהעירייה", "טמון קרקע"),
    ("אשפתון מלא", "כלי אצירה מלא", "אשפה ביתית", "אשפתון ציבורי"),
    ("טמוני קרקע מלאים", "כלי אצירה מלא", "אשפה ביתית", "טמון קרקע"),
    ("מיכל אשפה עילי מלא", "כלי אצירה מלא", "אשפה ביתית", "מיכל עילי"),
    ("פגר חתול", "פגר", "חתול", "רחוב"),
    ("פגר בעלי כנף", "פגר", "עוף", "רחוב"),
    ("פגר עכבר/קיפוד", "פגר", "מכרסם", "רחוב"),
    ("פגר חיה", "פגר", "חיה", "רחוב"),
    ("פח שנעלם", "פח נעלם", "בקשה מהעירייה", "פח"),
    ("שקיות איסוף צואת כלבים", "בקשת ציוד ציבורי", "בקשה מהעירייה", "לא ידוע"),
    ("צואת כלבים", "צואת כלבים", "צואת כלבים", "מדרכה"),
    ("עשבים במדרכה", "פלישת צומח", "בקשה מהעירייה", "מדרכה"),
    ("גראפיטי", "גראפיטי", "בקשה מהעירייה", "לא ידוע"),
    ("סחף אדמה", "סחף אדמה", "בקשה מהעירייה", "מדרכה"),
    ("פינוי אשפה חריג", "בקשה מיוחדת לפינוי", "אשפה ביתית", "לא ידוע"),
    ("פינוי פח 3700", "בקשה מיוחדת לפינוי", "אשפה ביתית", "פח"),
    ("פינוי אשפה בבית חדש", "בקשה מיוחדת לפינוי", "אשפה ביתית", "לא ידוע"),
    ("ריקון אשפה לפחים אחרים", "בקשה מיוחדת לפינוי", "אשפה ביתית", "פח"),
    ("טופס דיווח על גרימת נזק בשל פינוי אשפה", "תביעת נזק", "בקשה מהעירייה", "לא ידוע"),
]

# Category -> responsibility; UNKNOWN_RESP means the text decides.
RESPONSIBILITY = {
    "אי פינוי": "עירייה",
    "תלונה על ביצוע הפינוי": "עירייה",
    "כלי אצירה מלא": "עירייה",
    "כלי אצירה פגומים": UNKNOWN_RESP,
    "תביעת נזק": "עירייה",
    "משטח מלוכלך": UNKNOWN_RESP,
    "פח נעלם": UNKNOWN_RESP,
    "פסולת לא מורשית": "התנהגות אזרח",
    "צואת כלבים": "התנהגות אזרח",
    "גראפיטי": "התנהגות אזרח",
    "פגר": "טבעי",
    "סחף אדמה": "טבעי",
    "פלישת צומח": "טבעי",
    "בקשה מיוחדת לפינוי": "בקשה מהעירייה",
    "בקשת ציוד ציבורי": "בקשה מהעירייה",
}

# Responsibility keywords; the first label with a hit wins.
RESP_KEYWORDS = {
    "עירייה": [
        "שברו", "שבור", "דרסו", "נשבר", "החזירו", "לא החזירו", "הוחזר",
        "לא הוחזר", "לקחו", "נלקח", "נעלם אחרי פינוי", "נעלם לאחר פינוי",
        "היום בפינוי", "אחרי הפינוי", "לאחר הפינוי", "בפינוי",
        "מנקה רחובות", "אוטו ניקוי", "לא ניקו", "לא עברו עם", "לא עבר מנקה",
        "השאיר זבל", "השאיר ערמת", "מטאטא", "מפוח", "לא ניקה",
        "כבר שבועיים", "כבר שבועות", "כבר ימים", "הזנחה", "לא טופל",
    ],
    "התנהגות אזרח": [
        "פיזרו", "זרקו", "אנשים", "שכנים", "דיירים", "מישהו",
        "גנבו", "גנב", "נגנב", "עקרו", "פרצו",
        "כלב", "כלבים", "צואת כלבים", "בעל הכלב", "בעלי כלבים", "צואת כלב",
    ],
    "טבעי": [
        "גשם", "רוח", "עלים", "שלכת", "ענפים", "שיטפון",
        "חצץ שזורם", "סחף", "עצים נפלו",
        "יונים", "יונה", "ציפורים", "ציפור", "עורב", "עורבים",
        "צואת יונים", "צואת ציפורים", "בעלי כנף", "פרחים נשרו",
        "חתולים", "חתול",
    ],
}

# Topic -> category when the sub-topic is blank.
TOPICS = {
    "פינוי אשפה": "אי פינוי",
    "פינוי גזם ופסולת גושית": "אי פינוי",
    "תקלות בכלי אצירה": "כלי אצירה פגומים",
    "פינוי פגר": "פגר",
    "ניקיון": "משטח מלוכלך",
}

# Weekday names, Monday first.
WEEKDAYS = ["שני", "שלישי", "רביעי", "חמישי", "שישי", "שבת", "ראשון"]

# Month names, January first.
MONTHS = ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני",
          "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"]

# Phrases that ask for a call back.
CALLBACK_PHRASES = [
    "שיצרו איתה קשר", "שיצרו איתו קשר", "שיצרו קשר", "מבקש שיצרו",
    "מבקשת שיצרו", "שיתקשרו", "שיחזרו אלי", "שיחזרו אליה", "שיחזרו אליו",
    "לחזור אלי", "מבקש שיחזרו", "מבקשת שיחזרו", "ליצור קשר", "צרו קשר",
]

# Labels of older files and their current form.
LEGACY_RESPONSIBILITY = {
    "כשל עירוני": "עירייה",
    "לא רלוונטי": "בקשה מהעירייה",
}

# Words that carry no cause signal.
STOP_WORDS = [
    "של", "על", "את", "לא", "עם", "יש", "זה", "זו", "זאת", "גם", "אני", "הוא",
    "היא", "כי", "אבל", "או", "כמו", "אחרי", "לפני", "בין", "כבר", "מאוד", "פה",
    "שם", "ליד", "מול", "רחוב", "רח", "בית", "כתובת", "אזור", "מקום", "בבקשה",
    "תודה", "שלום", "פנייה", "פניה", "פונה", "מבקש", "מבקשת", "מבקשים", "צריך",
    "צריכה", "וגם", "אנא", "כאן", "היום", "אתמול", "שוב", "הרבה", "כל", "כמה",
    "מה", "יותר", "עדיין", "בגלל", "נמצא", "נמצאת", "וכן", "אחד", "אחת", "שני",
    "שתי", "הזה", "הזאת", "להיות", "גורם", "מספר", "דירה", "קומה", "כניסה",
    "בניין", "ברחוב", "וכו", "שכתובת", "גבי", "אך", "רק", "אם", "כדי", "כן",
    "לכן", "אשר", "היה", "היתה", "הייתה", "יהיה", "איזה", "איזו", "מתי", "למה",
    "לנו", "להם", "אלי", "אליו", "אליה", "שלנו", "שלהם", "שלי", "שלו", "שלה",
    "עדין", "מאד", "ליום", "בימים", "בשעה", "בשעות", "אחה", "בוקר", "ערב",
]

# Directional phrases that end the street name ("\b" = whole word).
DIRECTIONS = [
    r"ליד\b", r"מול\b", r"סמוך\s+ל", r"בין\b", r"לכיוון\b", r"לכיון\b", r"בכיוון\b",
    r"עד\b", r"לפני\b", r"אחרי\b", r"מאחורי\b", r"מעבר\s+ל", r"מול\s+ה",
    r"בכניסה\s+ל", r"ממול\b", r"בסמוך\b", r"ברחבת\b", r"בגינת\b",
    r"ליד\s+ה", r"מול\s+בית", r"בצד\b", r"בקרבת\b", r"בפינת\b",
    r"מתחת\s+ל", r"מעל\b", r"בצמוד\s+ל", r"בין\s+ה", r"ב?כיכר\b",
    r"עד\s+סוף", r"מהבריגדה\b", r"לאורך\b", r"בחלק\b",
]

# Raw addresses starting so name a place, not a street.
DESCRIPTIVE_PREFIXES = [
    "חוף", "פארק ", "גן הגאולה", "גן העירוני", "גן לאומי", "שמורת",
    "טיילת", "מרינה", "שפת הים", "חניון ", "מגרש משחקים", "גינת",
]

# Context rules for rows whose responsibility is still open.
HANDLED_WORD = "טופל"
HANDLED_CATEGORIES = ["כלי אצירה פגומים", "פח נעלם"]
BEACH_PREFIXES = ["חוף ", "שפת הים", "טיילת"]
NATURE_WORDS = ["עלים", "שלכת", "חול", "ים", "גשם", "רוח", "סחף"]
CITIZEN_WORDS = ["זרקו", "פיזרו", "השאירו", "אנשים", "שכנים"]

# Words before which a leaked street suffix starts.
SUFFIX_DESCRIPTORS = ["כניסה", "קומה", "דירה", "מתחם", "מגדל", "בניין"]
SUFFIX_PREPOSITIONS = [" ליד ", " מול ", " עד ", " בגינת ", " שליד ", " בחלק "]
WHOLE_STREET_ENDINGS = ["כל הרחוב", "לאורך כל הרחוב", "בכל הרחוב", "ויתקין בכל הרחוב"]
CROSSING_SHORTHANDS = [" פ ", " פ.", " פ'"]
INTERSECTION_MARK = "__INTERSECTION__"

# Expansions of a leading abbreviation in a geocoder query.
PREFIX_EXPANSIONS = [
    (r"(?U)^שד\b\.?\s*", "שדרות "),
    (r"(?U)^רח\b\.?\s*", "רחוב "),
    (r"(?U)^כ'\s*", "כביש "),
    (r"(?U)^דר\b\.?\s*", "דרך "),
]
QUERY_SUFFIX = ", הרצליה, ישראל"

# Zone -> collection weekday.
ZONE_DAYS = {
    "מרכז": "שני",
    "צפון": "שני",
    "דרום": "שלישי",
    "הרצליה ב": "שלישי",
    "מזרח": "רביעי",
    "מערב": "רביעי",
}
ZONE_UNKNOWN = "לא ידוע"
ZONE_OUTSIDE = "מחוץ לתחום"
ZONE_UNCERTAIN_M = 150.0

# Town box, sea line, and the wide box used for map rows.
BOX = (32.14, 32.20, 34.78, 34.87)
SEA_LON = 34.79
WIDE_BOX = (32.0, 33.0, 34.0, 36.0)
MAP_CENTRE = (32.166, 34.843)

# Flag code -> label.
FLAG_LABELS = {
    "no_date": "חסר תאריך",
    "no_id": "חסר מספר פניה",
    "date_early": "תאריך לפני התקופה",
    "date_late": "תאריך אחרי התקופה",
    "addr_none": "כתובת ריקה — לא ניתן לגאוקוד",
    "addr_desc": "כתובת תיאורית ללא רחוב מזוהה",
    "addr_empty": "כתובת ריקה",
    "addr_junk": "כתובת מכילה רק סימנים/מספרים",
    "no_house": "חסר מספר בית",
    "cat_unknown": "קטגוריה לא מזוהה",
    "no_status": "חסר סטטוס",
    "geo_fail": "לא גאוקודד",
    "geo_outside": "מחוץ לגבולות הרצליה",
    "geo_sea": "נקודה נופלת בים",
    "dup_id": "מספר פניה כפול",
}

# Geocode method -> precision tier.
METHOD_TIER = {
    "gis_exact": "address",
    "gis_nearest": "near_address",
    "gis_centroid": "street",
    "street_centroid_osm": "street",
    "gis_intersection": "street",
    "osm_centroid": "street",
    "manual": "address",
    "manual_backfilled": "address",
    "local_exact": "address",
    "local_nearest": "near_address",
    "local_street_centroid": "street",
    "street_zero_centroid": "street",
}
GEOCODER_METHODS = ["nominatim_original", "nominatim", "nominatim_cached"]
RELABEL_METHODS = ["unresolved", "flagged_description", "no_street"]

# Reject rate per precision tier; consumer risk.
TIERS = ["address", "near_address", "address_unverified", "street", "none"]
P_REJECT = {"address": 0.05, "near_address": 0.10, "address_unverified": 0.10,
            "street": 0.15, "none": 1.00}
P_REJECT_OTHER = 0.10
BETA = 0.10
SPOT_P_REJECT = 0.05
ACCEPT, REJECT = "✅ קבל", "❌ דחה"

# Who may write to the audit log.
AUDIT_SOURCES = [
    "auto_fix", "manual_editor", "bulk_paste", "gis_retry", "waive",
    "manual_review", "spot_check_approval", "user_qa",
    "user_override", "user_resp_term", "user_resp_default", "context_resolve",
]

# Known street centroids (street, latitude, longitude).
STREET_CENTROIDS = [
    ("אבניים", 32.16371, 34.850203),
    ("אוטו ורבורג", 32.156375, 34.844152),
    ("אופיר סמטה", 32.174387, 34.845778),
    ("אור חיים", 32.172397, 34.83291),
    ("אירוסים", 32.167343, 34.817444),
    ("אלט נויילנד", 32.155707, 34.801055),
    ("אלי לנדאו עד נילי", 32.168428, 34.800488),
    ("אנילביץ מרדכי", 32.175053, 34.847837),
    ("אנצו סירני", 32.165213, 34.806525),
    ("ארגוב סשה", 32.17347, 34.841234),
    ("אריה לייב יפה", 32.171197, 34.845379),
    ("בית הראשונים", 32.168166, 34.841869),
    ("בראון", 32.167829, 34.817541),
    ("גולומב אליהו", 32.173929, 34.84728),
    ("גיבורי עציון", 32.164022, 34.858076),
    ("דפנה האשל", 32.180214, 34.808347),
    ("האסיף", 32.180047, 34.842885),
    ("הבריגדה היהודית", 32.176266, 34.849103),
    ("הגדעונים", 32.17923, 34.812754),
    ("הדודאים שביל אדמית", 32.152888, 34.84922),
    ("הדסים", 32.176947, 34.847935),
    ("המעין", 32.168376, 34.852304),
    ("המעפילים", 32.181628, 34.812623),
    ("הס", 32.164708, 34.841489),
    ("הקדמה", 32.184253, 34.811576),
    ("הראובני דוד", 32.164239, 34.834635),
    ("הרב נורוק", 32.154833, 34.840871),
    ("הרב פישמן", 32.17206, 34.815768),
    ("הרימונים", 32.178767, 34.846385),
    ("הרצוג", 32.168058, 34.84649),
    ("ווינגיט", 32.176475, 34.80566),
    ("זהר טל", 32.171704, 34.8028),
    ("זיסו א.ל.", 32.177267, 34.854528),
    ("חנה רובינא", 32.165581, 34.829496),
    ("חפצי בה", 32.157511, 34.848938),
    ("חתם סופר", 32.152253, 34.843559),
    ("טשרנחובסקי", 32.169628, 34.841086),
    ("יגאל אלון", 32.168939, 34.847209),
    ("יהושוע בן נון", 32.165462, 34.8055),
    ("יהושפט המלך מול", 32.170268, 34.808081),
    ("לחי", 32.173967, 34.805458),
    ("מדינת היהודים", 32.166997, 34.807884),
    ("מוהוליבר", 32.165992, 34.850023),
    ("מורי עפארי", 32.16102, 34.85816),
    ("מנחם בגין שד", 32.178202, 34.831661),
    ("מרזוק משה", 32.17753, 34.852925),
    ("מרים החשמונאית", 32.160557, 34.850698),
    ("מתיתיהו", 32.166956, 34.804054),
    ("נוה עובד", 32.182418, 34.812901),
    ("סירקין", 32.166446, 34.845646),
    ("סנה משה", 32.161518, 34.851108),
    ("פתח תקוה", 32.159748, 34.851381),
    ("צבעוני", 32.152082, 34.850024),
    ("קהילת ציון", 32.164253, 34.84904),
    ("קורצ'ק יאנוש", 32.174184, 34.847173),
    ("קפלינסקי", 32.171675, 34.847599),
    ("רזיאל דוד", 32.157691, 34.849499),
    ("רייק חביבה", 32.165503, 34.80694),
    ("רפי וקנין", 32.169704, 34.861609),
    ("שביל אבו חצירא שירת גאולים", 32.154305, 34.837483),
    ("שד אלי לנדאו", 32.168428, 34.800488),
    ("שד יעקב לנצט", 32.165455, 34.841825),
    ("שוידלסון", 32.161177, 34.843567),
    ("שחל", 32.16258, 34.856693),
    ("שלום רוזנלפלד", 32.161286, 34.828979),
    ("שלומית כהן-קישיק", 32.160343, 34.831403),
]


@dataclass(frozen=True)
class Rules:
    """A classification vocabulary; the defaults are the municipal one."""

    subtopics: tuple = tuple(SUBTOPICS)
    topics: dict = field(default_factory=lambda: dict(TOPICS))
    responsibility: dict = field(default_factory=lambda: dict(RESPONSIBILITY))
    keywords: dict = field(default_factory=lambda: {k: list(v) for k, v in RESP_KEYWORDS.items()})

    @property
    def ambiguous(self) -> list[str]:
        return sorted(c for c, r in self.responsibility.items() if r == UNKNOWN_RESP)

    @property
    def categories(self) -> list[str]:
        return list(self.responsibility)


MUNICIPAL = Rules()
