"""Word lists, weights, patterns. Order is meaning: first hits are reported first."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------------------------------

PAGE_TYPES = ["homepage", "elections", "polling", "early_voting", "results"]
DISCOVERED_TYPES = PAGE_TYPES[1:]
BASE_COLUMNS = ["county", "batch", "page_type", "url", "external", "notes"]
AUDIT_COLUMNS = ["verify_status", "http_status", "final_url", "audit_confidence", "audit_reason", "flag_for_review"]

JS_SHELL = [
    "please enable javascript",
    "enable javascript to run this app",
    "you need to enable javascript",
    "this application requires javascript",
    "javascript is required",
    "javascript is disabled",
]

INTERSTITIAL = [
    "just a moment",
    "checking your browser",
    "verifying you are human",
    "cf-browser-verification",
    "challenge-platform",
    "cf_chl",
    "enable javascript and cookies to continue",
    "ddos protection by",
    "attention required! | cloudflare",
    "security check",
    "verifying your browser",
    "performing security verification",
    "performing a brief security check",
    "security service to protect",
]

SKIP_LINKS = [
    "javascript:",
    "mailto:",
    "tel:",
    "#",
    "/search",
    "search.results",
    "/login",
    "/rss",
    "facebook.com",
    "twitter.com",
    "youtube.com",
    "instagram.com",
    "linkedin.com",
    "x.com/",
    "t.co/",
    "nextdoor.com",
    "civicplus.com",
    "governmentjobs.com",
    "/myaccount",
    "/sitemap",
    "/privacy",
    "/copyright",
    "/accessibility",
    "quicklinks.aspx",
]

GENERIC_PORTALS = [
    "texas-election.com",
    "texas-elections.com",
    "votetexas.gov",
    "sos.state.tx.us",
    "sos.texas.gov",
    "wrm.capitol.texas.gov",
    "webservices.sos.state.tx.us",
    "votetexas.org",
    "dps.texas.gov",
    "vote411.org",
    "lwv.org",
    "vote.org",
    "ballotpedia.org",
    "rockthevote",
    "usa.gov",
    "eac.gov",
    "votesmart.org",
    "nass.org",
    "turbovote",
    "headcount.org",
    "when-we-all-vote",
    "voteamerica",
    "usvotefoundation.org",
    "overseasvotefoundation.org",
    "fairelectionscenter.org",
    "fvap.gov",
    "essvote.com",
    "hartintercivic.com",
    "dominionvoting.com",
    "clearballot.com",
    "unisynvoting.com",
    "verifiedvoting.org",
    "esands.com",
    "civixapps.com",
    "txelections.civixapps.com",
    "logis-us.net",
    "translate.goog",
    "translate.google.com",
]

BAD_HOSTS = [
    "facebook",
    "twitter",
    "linkedin",
    "yelp",
    "city-data",
    "countyoffice.org",
    "usa.com",
    "areaconnect",
    "zillow",
    "realtor",
    "netronline",
    "publicrecords",
    "wikipedia",
    "cad.org",
    "appraisal",
]

GOV = [
    "commissioners court",
    "commissioner's court",
    "county judge",
    "county clerk",
    "district clerk",
    "tax assessor",
    "sheriff",
    "justice of the peace",
    "county auditor",
    "county treasurer",
    "courthouse",
    "elections administrator",
    "county attorney",
    "commissioners' court",
    "county commissioners",
    "precinct",
]

COMMERCIAL = [
    "process server",
    "bail bond",
    "personal injury",
    "attorney advertising",
    "real estate listings",
    "for sale by owner",
    "insurance quotes",
    "add your business",
    "advertise with us",
    "sponsored listings",
]

NON_GOV = [
    "visitor center",
    "visitors bureau",
    "things to do",
    "where to stay",
    "places to eat",
    "itineraries",
    "economic development commission",
    "economic development corporation",
    "chamber of commerce",
    "convention and visitors",
    "historical society",
    "genealogical society",
    "plan your visit",
    "tourism",
]

NON_GOV_TITLE = [
    "economic development",
    "chamber of commerce",
    "visitors bureau",
    "visitor center",
    "tourism",
    "convention and visitors",
    "historical society",
    "genealogical society",
    "appraisal district",
]

PARKED = [
    "domain is for sale",
    "buy this domain",
    "parked",
    "this domain may be for sale",
    "godaddy",
    "sedo",
    "account suspended",
    "coming soon",
    "under construction",
    "default web site page",
    "index of /",
]

ERROR_PAGE = [
    "page not found",
    "404 not found",
    "403 forbidden",
    "access denied",
    "not be found",
    "site can't be reached",
]

BAD_PAGE = [
    "page not found",
    "404 error",
    "not be found",
    "no longer available",
    "access denied",
    "forbidden",
    "under construction",
    "account suspended",
    "domain is for sale",
    "this site can",
    "temporarily unavailable",
]

STRONG = {
    "homepage": ["county"],
    "elections": ["election", "voter", "voting", "ballot"],
    "polling": ["polling", "vote center", "voting center", "election day", "where to vote", "poll location"],
    "early_voting": ["early voting", "early vote", "advance voting"],
    "results": ["election result", "results", "returns", "canvass", "election night", "list elections", "unofficial"],
}
WEAK = {
    "homepage": ["commissioners", "district clerk", "tax", "sheriff", "county judge"],
    "elections": ["registration", "vote"],
    "polling": ["location", "precinct"],
    "early_voting": ["schedule", "hours"],
    "results": ["reporting", "precinct"],
}

LINK_WEIGHTS = {
    "elections": [
        ("election", 6),
        ("elections", 6),
        ("voter", 5),
        ("voting", 5),
        ("ballot", 3),
        ("vote", 3),
        ("elections administrator", 8),
        ("elections office", 8),
        ("voter registration", 5),
        ("candidate", -3),
        ("archive", -4),
        ("result", -3),
        ("history", -3),
        ("application", -9),
        ("registration application", -6),
        ("form", -5),
    ],
    "polling": [
        ("polling location", 12),
        ("polling place", 12),
        ("vote center", 10),
        ("voting center", 10),
        ("polling", 9),
        ("election day location", 11),
        ("election day vote", 10),
        ("where to vote", 9),
        ("precinct map", 5),
        ("early", -6),
        ("result", -6),
    ],
    "early_voting": [
        ("early voting location", 13),
        ("early voting schedule", 12),
        ("early voting", 11),
        ("early vote", 10),
        ("advance voting", 8),
        ("result", -6),
        ("election day", -4),
    ],
    "results": [
        ("election result", 13),
        ("election returns", 11),
        ("unofficial result", 12),
        ("results", 8),
        ("returns", 6),
        ("canvass", 6),
        ("election night", 10),
        ("search result", -12),
        ("polling", -6),
        ("early", -5),
    ],
}
DEPARTMENT_WEIGHTS = [
    ("county offices", 9),
    ("department", 8),
    ("government", 7),
    ("elected official", 6),
    ("directory", 5),
    ("services", 4),
    ("county clerk", 5),
    ("offices", 5),
]
HUB_WEIGHTS = [
    ("current election", 12),
    ("upcoming election", 11),
    ("election information", 9),
    ("general election", 8),
    ("primary election", 7),
    ("joint election", 7),
    ("election day information", 10),
    ("next election", 8),
    ("archive", -8),
    ("past", -8),
    ("result", -4),
    ("financial", -10),
]
FIRST_WEIGHTS = {
    "early_voting": [
        ("early voting", 5),
        ("early vote", 5),
        ("advance voting", 4),
    ],
    "polling": [
        ("polling", 5),
        ("vote center", 5),
        ("voting center", 5),
        ("polling location", 6),
        ("where to vote", 5),
        ("poll location", 5),
    ],
    "results": [
        ("election result", 6),
        ("results", 4),
        ("returns", 3),
        ("canvass", 3),
        ("enr", 2),
    ],
    "elections": [
        ("election", 4),
        ("elections", 4),
        ("voter", 4),
        ("voting", 3),
        ("ballot", 3),
        ("register to vote", 4),
        ("voter registration", 4),
    ],
}
MINIMUM = {"elections": 6, "polling": 9, "early_voting": 10, "results": 8}
EXTERNAL_PENALTY = {"elections": 2, "polling": 2, "early_voting": 2}

CACHE_PARAMETERS = ["ver", "v", "rev", "cachebust", "cache", "ts", "t", "_", "cdv", "cb", "build", "version", "vsn", "rnd", "r"]
DROPPED_TAGS = ["script", "style", "noscript", "svg", "template", "iframe"]
VOLATILE_INPUTS = [
    "__viewstate",
    "__viewstategenerator",
    "__viewstateencrypted",
    "__eventvalidation",
    "__eventtarget",
    "__eventargument",
    "__previouspage",
    "__scrollpositionx",
    "__scrollpositiony",
    "__requestverificationtoken",
]
VOLATILE_ATTRIBUTES = ["nonce", "integrity", "crossorigin", "style"]
VOLATILE_PARTS = ["csrf", "token", "nonce", "session", "viewstate"]
VOLATILE_META = ["published-version", "build-version", "buildid", "build-id", "revision", "x-wix-"]
ID_ATTRIBUTES = ["id", "class", "for", "aria-controls", "aria-labelledby", "aria-describedby", "headers", "name", "value", "href", "action"]
RANDOM_ATTRIBUTES = ["data-drupal-selector", "data-style-uid", "wire:id", "wire:snapshot", "wire:effects", "wire:initial-data"]
WIDGET_SIZES = ["wide", "narrow"]
PLAYBACK = ["evo_slideshow_pause", "paused", "is-paused", "playing", "is-playing", "evo_slideshow_play"]
WEATHER = ["weathercontainer", "weather-container", "weatherwidget", "weather-widget", "weatherblock", "weather-block", "weathericon", "current-weather", "weather-current"]
NOCACHE = ["nocache", "no-cache"]
INJECTED = ["audioeye", "accessibe", "userway", "usablenet", "recite-me", "recitememe", "equalweb", "docbox"]
LOAD_STATES = ["js", "no-js", "wf-active", "wf-loading", "wf-inactive", "loaded", "ready", "fontawesome-i2svg-active", "fontawesome-i2svg-complete", "fontawesome-i2svg", "is-ready", "dom-loaded", "page-loaded", "evo_slideshow_pause", "paused", "is-paused", "playing", "is-playing"]
DROPPED_RELS = ["preload", "modulepreload", "prefetch", "preconnect", "dns-prefetch", "prerender", "stylesheet"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
VOLATILE_ID_PREFIXES = ["gt-wrapper-", "ivs-gallery-"]
SLIDESHOWS = ["slideshow", "carousel", "swiper", "slick-slider", "glide__track", "splide__track"]
SLIDESHOW_TEXT = "[rotating image slideshow removed for determinism]"
WEATHER_TEXT = "[live weather removed for determinism]"
ELECTION_LABELS = [
    "elections",
    "election",
    "elections & voting",
    "voting & elections",
    "elections and voting",
    "voting and elections",
    "election information",
    "elections department",
    "elections administration",
    "elections office",
    "voter information",
    "elections & voter registration",
    "voting information",
    "elections/voter registration",
    "vote",
    "voting",
]
CANDIDATE_HOSTS = [
    "www.co.{squashed}.tx.us",
    "co.{squashed}.tx.us",
    "www.co.{hyphened}.tx.us",
    "co.{hyphened}.tx.us",
    "www.{squashed}countytx.gov",
    "{squashed}countytx.gov",
    "www.{squashed}county.gov",
    "{squashed}county.gov",
    "www.{squashed}countytexas.gov",
    "www.{squashed}tx.gov",
    "{squashed}tx.gov",
    "{squashed}county.texas.gov",
    "www.{squashed}county.texas.gov",
    "www.{squashed}countytx.com",
    "www.{squashed}county.org",
    "www.{squashed}countytx.org",
]
