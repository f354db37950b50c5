"""Fixed data of the scoring engine: word lists, region packs, hosts, suffixes, numbers, seasons.

All lists are fixed values in order of precedence and are this engine's own.  ``pack`` gives the lists of a
region: the base lists followed by the region's; ``entries`` lists every pack as rows for joins.
"""

from __future__ import annotations

#: Lists that hold everywhere; urgency is kept in groups, which are flattened in this order.
URGENCY_GROUPS = {
    "generic": ("act now", "immediately", "urgent", "expires today", "final notice", "last warning", "within 24 hours", "account suspended", "account locked", "avoid interruption"),
    "foreign_authority": ("arrest warrant", "visa cancelled", "deportation", "embassy notice"),
    "toll": ("unpaid toll", "toll overdue", "toll balance", "licence suspension"),
    "parcel": ("parcel on hold", "delivery failed", "package could not be delivered", "customs fee due"),
    "voice_clone": ("it is me", "i lost my voice", "i have had an accident"),
    "utility": ("disconnection notice", "power will be cut", "service disconnection"),
    "pension": ("pension review", "benefit payment stopped"),
    "recall": ("product recall refund",),
    "tax": ("tax refund", "outstanding tax", "tax office"),
    "tax_threat": ("tax evasion", "legal proceedings"),
}
BASE = {
    "urgency": tuple(w for group in URGENCY_GROUPS.values() for w in group),
    "reward": ("you have won", "claim your prize", "free gift", "lottery", "jackpot", "cash prize", "gift card", "claim", "bonus payout", "lucky winner"),
    "ask": ("password", "pin number", "card number", "security code", "one time code", "bank details", "date of birth", "login details", "account number", "cvv"),
    "service": ("online banking", "mobile wallet", "netbanking"),
    "coaching": ("do not tell the bank", "tell the bank it is for", "keep this secret", "do not tell anyone", "say it is a family gift"),
    "family": ("mum", "mom", "dad", "grandma", "grandpa"),
    "pretext": ("new number", "lost my phone", "broke my phone", "phone fell in", "temporary number"),
    "money_ask": ("send money", "pay a bill", "transfer", "lend me", "need to pay"),
    "callback_brands": ("geek squad", "norton", "mcafee", "paypal"),
    "exchanges": ("coinbase", "binance", "kraken"),
    "platforms": ("quantum ai trader", "bitprime pro", "immediate edge", "tesler app"),
    "brands": ("paypal", "netflix", "amazon", "microsoft", "apple", "facebook", "instagram", "coinbase"),
    "keys_by_post": ("keys by post", "send you the keys", "keys will be mailed"),
    "jobs": ("work from home", "daily pay", "no experience", "flexible hours", "simple tasks", "earn per day"),
    "investment": ("trading group", "guaranteed returns", "investment group", "trading signals", "double your money"),
    "crypto": ("bitcoin", "crypto", "usdt", "ethereum"),
    "reregistration": ("re register your identity", "update your id", "verify your identity again"),
    "foreign_authority": ("chinese embassy", "chinese consulate", "chinese police", "interpol officer", "overseas police"),
    "misspelt": ("kindly do the needful", "recieve", "acount", "verfy", "securty"),
}
#: Region packs: what a region adds, and how far it is covered; flags are pack-dependent switches.
PACKS = {
    "AU": {"tier": "full", "authority": ("australia post", "ato", "medicare", "centrelink", "mygov", "linkt"), "no_link_senders": ("ato", "mygov"), "legit": ("auspost.com.au", "ato.gov.au", "my.gov.au", "servicesaustralia.gov.au"), "official_suffix": ".gov.au", "urgency": ("linkt overdue", "mygov suspended"), "plan": "61", "flags": ("unverified_sender", "chat_authority")},
    "GB": {"tier": "full", "authority": ("hmrc", "royal mail", "dvla", "nhs", "dwp", "evri"), "no_link_senders": ("hmrc", "dvla"), "legit": ("royalmail.com", "gov.uk", "nhs.uk"), "official_suffix": ".gov.uk", "urgency": ("council tax arrears", "dart charge"), "plan": "44", "flags": ("chat_authority",)},
    "US": {"tier": "full", "authority": ("irs", "usps", "social security administration", "fedex", "e zpass", "medicare"), "no_link_senders": ("irs",), "legit": ("usps.com", "irs.gov", "ssa.gov", "fedex.com"), "official_suffix": ".gov", "urgency": ("stimulus check", "ssn suspended"), "plan": "1", "flags": ()},
    "NZ": {"tier": "full", "authority": ("nz post", "inland revenue", "waka kotahi", "work and income"), "no_link_senders": ("inland revenue",), "legit": ("nzpost.co.nz", "ird.govt.nz"), "official_suffix": ".govt.nz", "urgency": ("rego overdue",), "plan": "64", "flags": ()},
    "IE": {"tier": "full", "authority": ("an post", "revenue commissioners", "eflow", "hse"), "no_link_senders": ("revenue commissioners",), "legit": ("anpost.com", "revenue.ie", "gov.ie"), "official_suffix": ".gov.ie", "urgency": ("eflow toll",), "plan": "353", "flags": ("chat_authority",)},
    "CA": {"tier": "full", "authority": ("canada post", "cra", "service canada", "interac"), "no_link_senders": ("cra",), "legit": ("canadapost.ca", "canada.ca"), "official_suffix": ".gc.ca", "urgency": ("e transfer expires",), "plan": "1", "flags": ()},
    "DE": {"tier": "partial", "authority": ("deutsche post", "finanzamt", "zoll", "sparkasse"), "no_link_senders": (), "legit": ("dhl.de", "bund.de"), "official_suffix": "", "urgency": (), "plan": "49", "flags": ()},
    "FR": {"tier": "partial", "authority": ("la poste", "impots", "ameli", "antai"), "no_link_senders": (), "legit": ("laposte.fr", "gouv.fr"), "official_suffix": ".gouv.fr", "urgency": (), "plan": "33", "flags": ()},
    "IN": {"tier": "partial", "authority": ("india post", "uidai", "income tax department", "sbi"), "no_link_senders": (), "legit": ("indiapost.gov.in", "uidai.gov.in"), "official_suffix": ".gov.in", "urgency": ("kyc expired",), "plan": "91", "flags": ()},
    "AE": {"tier": "minimal", "authority": ("emirates post", "dubai police", "rta"), "no_link_senders": (), "legit": ("emiratespost.ae",), "official_suffix": ".gov.ae", "urgency": (), "plan": "971", "flags": ("chat_authority",)},
    "SG": {"tier": "minimal", "authority": ("singpost", "iras", "cpf board"), "no_link_senders": (), "legit": ("singpost.com", "gov.sg"), "official_suffix": ".gov.sg", "urgency": (), "plan": "65", "flags": ()},
    "ZZ": {"tier": "none", "authority": (), "no_link_senders": (), "legit": (), "official_suffix": "", "urgency": (), "plan": "", "flags": ()},
}
REGION_NAMES = {"AU": "Australia", "GB": "United Kingdom", "US": "United States", "NZ": "New Zealand", "IE": "Ireland", "CA": "Canada", "DE": "Germany", "FR": "France", "IN": "India", "AE": "United Arab Emirates", "SG": "Singapore", "ZZ": "Elsewhere"}
DEFAULT_REGION = "AU"
_OWN = ("urgency", "authority", "no_link_senders", "legit")


def pack(region: str | None) -> dict:
    """The lists of a region, base entries first; unknown regions resolve to the default."""
    own = PACKS.get(region or "", PACKS[DEFAULT_REGION])
    lists = {name: tuple(dict.fromkeys((*BASE.get(name, ()), *own.get(name, ())))) for name in (*BASE, *_OWN)}
    return {**lists, "flags": own["flags"], "tier": own["tier"], "official_suffix": own["official_suffix"], "plan": own["plan"]}


def entries() -> list[tuple[str, str, int, str]]:
    """(region, list, ordinal, value) of every pack; region '' has the base lists."""
    rows = [("", name, i, v) for name, values in BASE.items() for i, v in enumerate(values)]
    return rows + [(r, name, i, v) for r, p in PACKS.items() for name in _OWN for i, v in enumerate(p[name])]


#: Hosts.
ABUSED_TLDS = ("zip", "top", "xyz", "click", "icu", "cam", "rest", "quest")
BRANDS = ("paypal", "netflix", "amazon", "microsoft", "facebook", "instagram", "coinbase", "auspost")
WORD_BRANDS = ("ato", "irs", "dhl", "ups")
SHORTENERS = ("bit.ly", "t.co", "tinyurl.com", "is.gd", "goo.gl", "ow.ly", "rb.gy", "cutt.ly")
HOSTING = {"web.app": 35, "pages.dev": 35, "weebly.com": 25, "blogspot.com": 15, "github.io": 15, "netlify.app": 35}
IPFS_GATEWAYS = ("ipfs.io", "dweb.link", "cf-ipfs.com")
IDENTITY_HOSTS = ("accounts.google.com", "login.microsoftonline.com", "appleid.apple.com", "github.com", "okta.com")
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "igshid", "msclkid", "mc_cid", "mc_eid", "yclid", "twclid", "ttclid", "li_fat_id", "_hsenc", "_hsmi", "vero_id", "oly_anon_id", "oly_enc_id", "rb_clickid", "s_cid", "ref", "ref_src")
#: Public suffixes below the last label, with wildcard rules and their exceptions.
SUFFIX_RULES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "nhs.uk", "com.au", "net.au", "org.au", "gov.au", "edu.au", "id.au", "co.nz", "govt.nz", "org.nz", "co.jp", "or.jp", "ne.jp", "com.br", "gov.br",
    "co.in", "gov.in", "org.in", "co.za", "gov.za", "com.sg", "gov.sg", "gov.ie", "gc.ca", "gov.ae", "gouv.fr", "com.mx", "com.tr", "com.cn", "gov.cn", "blogspot.com", "github.io", "web.app", "pages.dev", "netlify.app",
    "*.ck", "!www.ck", "*.bd", "*.kawasaki.jp", "!city.kawasaki.jp", "*.compute.amazonaws.com",
)
#: Second-level suffixes under which a country's companies register.
COMMERCIAL = ("co.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.sg", "com.mx", "com.tr", "com.cn")
#: Where shortened links lead: a table that a crawl would fill.
REDIRECTS = (("bit.ly", "t.co"), ("t.co", "paypal-login.xyz"), ("tinyurl.com", "example.com"), ("is.gd", "rb.gy"), ("rb.gy", "ow.ly"), ("ow.ly", "cutt.ly"), ("cutt.ly", "goo.gl"))

#: Pressure classes and a pattern for each.
PRESSURE = (
    ("deadline", r"(today|tonight|within [0-9]+ hours|before midnight|expires)"),
    ("scarcity", r"(only [0-9]+ left|last chance|few left|limited)"),
    ("conditional-reward", r"(if you (?:pay|reply|act)|unless you)"),
    ("loss-framing", r"(lose|lost|miss out|forfeit)"),
    ("social-proof", r"(everyone|thousands of|others have)"),
    ("exclusivity", r"(only for you|selected|chosen|exclusive)"),
    ("escalation", r"(legal action|police|final warning|must)"),
)
#: Tactics by the first part of the rules that show them.
TACTICS = (("urgency", "urgency|parcel|toll"), ("impersonation", "authority|brand|family|status"), ("too-good", "reward|winnings|jobs|investment"), ("borrowed-authority", "authority|foreign"), ("unusual-payment", "small_fee|recovered|task_payment|crypto"), ("rapport", "family|coaching"))

ENGLISH_STOP_WORDS = ("the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "with", "as", "be", "by", "at", "this", "from", "or", "are", "a", "an")

#: Country calling codes: code, country, class of call-back risk.
CALLING_CODES = (
    ("1", "US", "low"), ("1242", "BS", "high"), ("1246", "BB", "medium"), ("1268", "AG", "high"), ("1473", "GD", "high"), ("1649", "TC", "high"), ("1664", "MS", "high"), ("1876", "JM", "high"), ("7", "RU", "medium"),
    ("20", "EG", "medium"), ("27", "ZA", "low"), ("33", "FR", "low"), ("34", "ES", "low"), ("39", "IT", "low"), ("44", "GB", "low"), ("49", "DE", "low"), ("52", "MX", "medium"), ("55", "BR", "medium"),
    ("61", "AU", "low"), ("62", "ID", "medium"), ("63", "PH", "medium"), ("64", "NZ", "low"), ("65", "SG", "low"), ("81", "JP", "low"), ("86", "CN", "medium"), ("91", "IN", "medium"), ("92", "PK", "medium"),
    ("216", "TN", "high"), ("222", "MR", "high"), ("225", "CI", "medium"), ("233", "GH", "medium"), ("234", "NG", "high"), ("252", "SO", "high"), ("269", "KM", "high"), ("353", "IE", "low"), ("371", "LV", "high"), ("375", "BY", "high"), ("675", "PG", "high"), ("881", "satellite", "high"), ("971", "AE", "low"),
)
#: Number plans: calling code, trunk prefix, digits after it, and prefixes of each type.
PLANS = {
    "AU": {"code": "61", "trunk": "0", "length": (9, 9), "emergency": ("000", "112"), "premium": ("190",), "free": ("1800",), "shared": ("13", "1300"), "mobile": ("4",), "voip": ("550",), "fixed": ("2", "3", "7", "8")},
    "GB": {"code": "44", "trunk": "0", "length": (9, 10), "emergency": ("999", "112"), "premium": ("90", "91", "98"), "free": ("800", "808"), "shared": ("84", "87"), "mobile": ("7",), "voip": ("56",), "fixed": ("1", "2")},
    "US": {"code": "1", "trunk": "1", "length": (10, 10), "emergency": ("911",), "premium": ("900",), "free": ("800", "833", "844", "855", "866", "877", "888"), "shared": (), "mobile": (), "voip": ("500",), "fixed": ("2", "3", "4", "5", "6", "7", "8", "9")},
}

#: Seasons: name, first and last month and day; one wraps the year's end.
SEASONS = (("new-year", 12, 20, 1, 10), ("winter-sale", 1, 8, 1, 21), ("tax", 1, 15, 2, 28), ("late-january", 1, 25, 1, 31), ("easter", 3, 20, 4, 25), ("summer", 6, 1, 8, 31), ("black-friday", 11, 20, 12, 2))
#: Radar entries: ordinal, lure, region, status, channel.
RADAR = (
    (1, "unpaid toll", "AU", "active", "sms"), (2, "parcel on hold", "GB", "active", "sms"), (3, "tax refund", "US", "active", "email"), (4, "job offer in a chat", "AU", "circulating", "chat"),
    (5, "bank security call", "GB", "active", "phone"), (6, "prize survey", "ZZ", "dormant", "web"), (7, "rental deposit", "IE", "circulating", "email"), (8, "crypto mentor", "CA", "active", "chat"),
    (9, "toll overdue", "US", "circulating", "sms"), (10, "pension review", "NZ", "dormant", "phone"), (11, "voice message", "AU", "active", "email"), (12, "giveaway", "IN", "circulating", "web"),
)
RADAR_CHANNELS = ("sms", "email", "phone", "web", "chat", "post")
ZONES = {"AU": "Australia/Sydney", "GB": "Europe/London", "US": "America/New_York", "NZ": "Pacific/Auckland", "IN": "Asia/Kolkata"}
#: Sending platforms by a part of a pixel's link; the first that matches names it.
SENDERS = (("list-manage.com", "mailchimp"), ("sendgrid.net", "sendgrid"), ("hubspot", "hubspot"), ("mailgun", "mailgun"), ("klaviyo", "klaviyo"), ("awstrack.me", "ses"), ("sparkpost", "sparkpost"), ("mandrillapp", "mandrill"))
