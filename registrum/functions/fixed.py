"""Fixed values that results depend on: word lists, label maps, markers, formats. All in natural order."""

# --- fixed values: keywords and exclusions -----------------------------------------------------------------------------
STANDARD_KEYWORDS = [
    "gates", "driveway gates", "entrance gates", "electric gates", "automated gates", "sliding gates", "swing gates",
    "metal gates", "timber gates", "vehicular gates", "pedestrian gate", "vehicular access", "new access",
    "alterations to access", "widen existing access", "driveway access", "access improvements", "front boundary",
    "boundary treatment", "boundary wall", "front wall", "boundary enclosure", "railings", "gate piers", "brick piers",
    "entrance piers", "pillars", "erection of gates", "installation of gates", "new entrance gates",
    "automated entrance gates", "electric driveway gates", "boundary wall and gates", "front boundary wall and gates",
    "new vehicular access and gates", "alterations to front boundary", "replacement gates", "new gate piers",
    "entrance walls and gates",
]
EXCLUDED_PHRASES = [
    "variation of condition", "discharge of condition", "details required by", "request for eia", "compliance with",
    "details of reserved matters", "submission of details", "details pursuant to", "section 73", "application to vary",
    "submission of material", "submission of surface", "edc consultation", "removal of condition", "partial approval of",
    "noise assessment", "holly -", "please note this is not a planning application", "application for approval of details",
    "details submitted to satisfy", "display for temporary period", "adjoining consultation", "pending decision",
    "1 x apple", "consultation by", "consultation request", "details of tree",
]
EXCLUDED_PREFIXES = ["t1", "g1", "details of condition", "detail of condition", "removal condition"]

# --- fixed values: output columns --------------------------------------------------------------------------------------
APPLICATION_COLUMNS = ["Reference", "address", "application link", "proposal", "date received", "council"]
FAILURE_COLUMNS = ["council", "portal_family", "scraper_type", "listing_url", "reason"]
HISTORY_COLUMNS = [
    "Search Date", "Search Time", "Keyword Set", "Total Applications", "Relevant Captured Applications", "% Relevant",
    "List of failed councils", "List of councils with no applications", "Completion", "Captured Documents",
]

# --- fixed values: authorities -----------------------------------------------------------------------------------------
AGGREGATOR_ALIASES = {
    "Aylesbury Vale": ["Buckinghamshire"], "Brighton and Hove": ["Brighton"], "Chiltern South Bucks": ["Buckinghamshire"],
    "West Somerset": ["Somerset"], "Windsor and Maidenhead": ["Windsor"], "Wycombe": ["Buckinghamshire"],
}
AGGREGATOR_FIRST = ["Birmingham", "South Cambridgeshire", "Surrey"]
PORTAL_OVERRIDES = {
    "East Hampshire": ("tascomi", "Tascomi", "https://publicaccess.easthants.gov.uk/planning/"),
    "Nuneaton": ("tascomi", "Tascomi", "https://idoxcloud.nuneatonandbedworth.gov.uk/planning/"),
}
PORTAL_OVERRIDE_QUERY = "index.html?fa=search"

# --- fixed values: label maps ------------------------------------------------------------------------------------------
GENERIC_LABELS = {
    "reference": ["reference", "application_reference", "application_ref", "application_number", "application_no", "planning_reference", "planning_application_reference", "case_no"],
    "address": ["site_address", "development_address", "address", "location", "location_address", "site_location", "location_of_development"],
    "description": ["proposal", "proposed_development", "description", "description_of_development", "development_description"],
    "status": ["status", "application_status", "current_status"],
    "decision": ["decision", "decision_type"],
    "date_received": ["date_received", "application_received", "application_received_date", "received_date", "received"],
    "date_validated": ["valid_date", "application_valid", "application_valid_date", "date_validated", "validated_date", "validated", "date_registered", "registration_date", "application_registered"],
    "applicant_name": ["applicant", "applicant_name"],
    "agent_name": ["agent", "agent_name"],
    "case_officer": ["case_officer", "officer"],
    "ward": ["ward", "ward_name", "wards"],
    "parish": ["parish"],
}
FORM_LABELS = {
    "reference": ["application_reference", "application_ref", "application_number", "reference_number", "reference", "application", "application_no", "application_id", "name", "app_no", "app_number", "case_reference"],
    "address": ["development_address", "address_of_proposal", "site_location", "site_address", "location", "location_details", "address"],
    "description": ["proposed_development", "proposal", "description", "development_description", "summary", "development"],
    "date_received": ["received_date", "date_received", "receiveddate", "registered", "registered_date", "registration_date"],
    "date_validated": ["valid_from_date", "valid_from", "validfrom", "valid_date", "date_valid"],
    "decision": ["decision"],
    "decision_date": ["decision_date"],
    "status": ["status"],
    "ward": ["ward"],
    "parish": ["parish"],
}
IDOX_LABELS = {
    "reference": ["reference", "caseno", "case_no", "application_reference", "planning_reference", "application_number"],
    "address": ["address", "site_address", "location"],
    "description": ["proposal", "description", "development_description"],
    "status": ["status", "application_status"],
    "decision": ["decision"],
    "date_received": ["date_received", "received", "application_received"],
    "date_validated": ["valid_date", "date_valid", "date_validated", "validated", "application_validated"],
    "applicant_name": ["applicant_name", "applicant"],
    "agent_name": ["agent_name", "agent"],
    "case_officer": ["case_officer", "officer"],
    "ward": ["ward"],
    "parish": ["parish"],
}
OCELLA_LABELS = {
    "reference": ["reference", "application_reference", "application_number", "application_no", "case_no"],
    "address": ["site_address", "address", "location"],
    "description": ["proposal", "description", "development_description"],
    "status": ["status", "application_status"],
    "decision": ["decision"],
    "date_received": ["date_received", "received_date", "received"],
    "date_validated": ["accepted", "valid_date", "date_validated", "validated"],
    "applicant_name": ["applicant", "applicant_name"],
    "agent_name": ["agent", "agent_name"],
    "case_officer": ["case_officer"],
    "ward": ["ward"],
    "parish": ["parish"],
}
LABELS = {"generic": GENERIC_LABELS, "forms": FORM_LABELS, "idox": IDOX_LABELS, "ocella": OCELLA_LABELS}
#: Whether the first or the last value of a column wins.
LABEL_ORDER = {"generic": "first", "forms": "first", "idox": "last", "ocella": "last"}

# --- fixed values: portal signatures, in order -------------------------------------------------------------------------
SIGNATURES = [
    ("idox", ["publicaccess", "applicationdetails.do", "online-applications"]),
    ("arcus", ["arcus_be_public_register", "register-view?c__r=", "my.site.com/pr/"]),
    ("ocella", ["ocella", "ocellaweb", "ocella planning"]),
    ("northgate", ["northgate", "planning explorer", "general_search.aspx"]),
    ("civica", ["civica", "authority public access", "planningexplorer", "webforms/planning/details.html"]),
    ("agile", ["agile applications", "agileapplications.co.uk", "wphappdetail.displayurl", "/apas/run/"]),
    ("achieveforms", ["achieveforms", "fs.formdefinition", "form_uri=sandbox-publish", "/fillform/"]),
    ("atrium", ["/search/advanced", "/search/results", "/planning/display/", "list of planning cases - search results"]),
    ("tascomi", ["tascomi", "fa=getapplication", "fa=search", "received_date_from"]),
    ("enterprisestore", ["onlineplanningsearch", "onlineplanningoverview", "urlonlineplanningsearchresult"]),
    ("appsearchserv", ["applicationsearchservlet", "appsearchform", "validdatefrom"]),
    ("fastweb", ["fastweb", "datereceivedstart", "detail.asp?altref"]),
    ("cced", ["cced", "dorsetcouncil.gov.uk/advsearch", "txtdatereceivedfrom"]),
    ("astun", ["developmentcontrol.aspx", "developmentcontroladvancedsearch.tmplt", "dateaprecv:from:date"]),
]
PLATFORM_MARKERS = [
    ("idox", "idox"), ("arcus", "arcus"), ("achieveforms", "achieveforms"), ("achieve forms", "achieveforms"), ("atrium", "atrium"),
    ("tascomi", "tascomi"), ("enterprisestore", "enterprise-store"), ("enterprise store", "enterprise-store"),
    ("appsearchserv", "app-search-serv"), ("fastweb", "fastweb"), ("cced", "cced"), ("astun", "astun"), ("socrata", "socrata"),
    ("statmap", "statmap"), ("ocella", "ocella"), ("agile", "agile"), ("civica", "civica"), ("northgate", "northgate"),
    ("planningexplorer", "northgate"),
]
SALESFORCE_AUTHORITIES = ["eastleigh", "wiltshire"]

# --- fixed values: adapters of single authorities and of authority sets ------------------------------------------------
#: Authority (lower case), its adapter, and the kind of portal that adapter reads.
AUTHORITIES = [
    ("ashford", "ashford", "arcus"), ("bath", "bath", "forms"), ("bath and north east somerset", "bath", "forms"), ("bcp", "bcp", "atrium"),
    ("wychavon", "wychavon", "atrium"), ("barking and dagenham", "barking and dagenham", "forms"), ("worcestershire", "worcestershire", "atrium"),
    ("worcester", "worcester", "atrium"), ("wokingham", "wokingham", "forms"), ("west sussex", "west sussex", "atrium"),
    ("west northamptonshire", "west northamptonshire", "atrium"), ("welwyn hatfield", "welwyn hatfield", "atrium"),
    ("waltham forest", "waltham forest", "forms"), ("vale of white horse", "vale of white horse", "atrium"), ("bromley", "bromley", "arcus"),
    ("carmarthenshire", "carmarthenshire", "arcus"), ("colchester", "colchester", "forms"), ("broxbourne", "broxbourne", "forms"),
    ("taunton deane", "taunton deane", "forms"), ("camden", "camden", "forms"), ("central bedfordshire", "central bedfordshire", "forms"),
    ("tandridge", "tandridge", "forms"), ("surrey", "surrey", "atrium"), ("stratford on avon", "stratford on avon", "forms"),
    ("coventry", "coventry", "forms"), ("south oxfordshire", "south oxfordshire", "atrium"), ("crawley", "crawley", "atrium"),
    ("devon", "devon", "atrium"), ("dorset", "dorset", "forms"), ("east sussex", "east sussex", "forms"), ("eastleigh", "eastleigh", "forms"),
    ("elmbridge", "elmbridge", "forms"), ("somerset", "somerset", "atrium"), ("essex", "essex", "atrium"), ("exmoor", "exmoor", "atrium"),
    ("gloucestershire", "gloucestershire", "forms"), ("kensington", "kensington", "forms"), ("kensington and chelsea", "kensington", "forms"),
    ("shepway", "shepway", "arcus"), ("telford", "telford", "forms"), ("west dunbartonshire", "west dunbartonshire", "forms"),
]
AUTHORITY_ADAPTERS = {kind: [key for key, _, k in AUTHORITIES if k == kind] for kind in ("arcus", "atrium", "forms")}
LIST_AUTHORITIES = ["copeland", "scilly isles", "south derbyshire", "amber valley", "stratford on avon", "cumberland"]
QUERY_AUTHORITIES = [
    "east sussex", "kirklees", "nottinghamshire", "preston", "tandridge", "boston", "barrow", "central bedfordshire", "hampshire", "herefordshire", "ipswich",
    "ribble valley", "sedgemoor", "taunton deane",
]

# --- fixed values: error texts -----------------------------------------------------------------------------------------
RATE_LIMITED = ["http 429", "too many requests", "rate limit"]
BLOCKED = ["http 403", "forbidden", "web application firewall"]
UNAVAILABLE = ["http 503"]
FRESH_SESSION = [
    "http 403", "http 429", "http 500", "http 502", "http 503", "http 504", "blocked by web application firewall", "document is empty", "empty response",
    "invalid arcus search response", "network error", "timed out", "timeout",
]
RESPONSIVE = [
    "http 400", "http 401", "http 403", "http 404", "http 405", "http 406", "http 409", "http 410", "http 418", "http 422", "http 429",
    "blocked by web application firewall", "forbidden", "could not determine", "could not find", "document is empty", "empty response",
    "invalid arcus search response", "invalid json", "not valid xml", "requires a detail url",
]
OUTAGE = ["http 500", "http 502", "http 503", "http 504", "connection refused", "getaddrinfo failed", "name or service not known", "no such host"]

AGGREGATOR_HOST = "planit.org.uk"

# --- fixed values: form fields that change with every page ------------------------------------------------------------
TRANSIENT = ["token"]

# --- fixed values: limiter ---------------------------------------------------------------------------------------------
PLATFORM_LIMITS = {"planit": 1, "salesforce": 1, "arcus": 2, "idox": 3, "custom": 3}
DEFAULT_LIMIT, HOST_LIMIT = 2, 1
COOLDOWN_SECONDS = {"rate_limited": 15.0, "blocked": 8.0, "service_unavailable": 8.0}
RECOVERY_SUCCESSES, FAILURES_TO_REDUCE = 4, 2
INACTIVITY_SECONDS, ATTEMPT_SECONDS = 120, 1200

# --- fixed values: documents and files ---------------------------------------------------------------------------------
HREF_SCHEMES = ["javascript:", "mailto:", "tel:", "#"]
HREF_DENIED = ["userguide", "prior1997", "/templates/", "content?id="]
HREF_MARKERS = [
    "document", "download", "attachment", "docview", "doclist", "showdocuments", "viewdocument", "displaysearchdocument", "wphappdocs", "wchdisplaymedia",
    "displaymedia", "showimage", "filedownload", "getfile", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".zip", ".dwg", ".dxf",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".rtf", ".txt",
]
SITE_DOCUMENT_ALLOWED = ["design and access", "access statement"]
SITE_DOCUMENT_TOKENS = [
    "accessibility", "cookie", "privacy", "terms-and-conditions", "terms conditions", "terms%20and%20conditions", "site-map", "sitemap", "contact-us", "contact us",
    "complaints", "modern-slavery", "freedom-of-information", "foi", "userguide", "user-guide", "adobe", "acrobat",
    "/documentproduction/letters/documentqueue", "/onlineplanning/getonlinedocumentscount", "/onlineplanning/getonlinedocuments",
    "/onlineplanning/getcommentattachments", "/onlinedisplaydocument/opencommentattachment",
]
#: Markers of document addresses in the dialects that list few: a deny-list of one marker for idox, none for the others.
DIALECT_MARKERS = {
    "generic": ["document", "attachment", "download", "docview", "doclist", ".pdf", ".doc", ".docx", ".jpg", ".jpeg", ".png"],
    "ocella": ["document", "attachment", "download", ".pdf", ".doc", ".docx", ".jpg", ".jpeg", ".png"],
    "idox": ["documentdownload", "documentviewer", "document.do", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".jpg", ".jpeg", ".png"],
}
#: Markers of application links by family, in address and text or in the address alone.
LINK_MARKERS = {
    "generic": ["planning", "application", "detail", "case", "app"],
    "ocella": ["planning", "application", "detail", "case", "app"],
    "northgate": ["stddetails.aspx", "planningpk.xml", "applicationdetails", "/detail"],
    "htmllist": ["planning", "application", "/application/", "eplanning", "detail"],
}
DOCUMENT_TITLES = ["documents", "view associated documents", "associated documents"]
DOCUMENT_TITLE_HREFS = ["searchresult", "publicaccess", "documents", "runthirdpartysearch"]
DOCUMENT_TYPES = ["pdf", "document", "drawing", "plan", "supporting_document", "image"]
EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".rtf", ".txt", ".csv", ".zip", ".dwg", ".dxf", ".jpg", ".jpeg", ".png", ".gif",
    ".bmp", ".webp", ".tif", ".tiff", ".heic",
]
CONTENT_TYPES = {
    ".pdf": ["application/pdf"],
    ".doc": ["application/msword"],
    ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    ".xls": ["application/vnd.ms-excel"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    ".ppt": ["application/vnd.ms-powerpoint"],
    ".pptx": ["application/vnd.openxmlformats-officedocument.presentationml.presentation"],
    ".odt": ["application/vnd.oasis.opendocument.text"],
    ".ods": ["application/vnd.oasis.opendocument.spreadsheet"],
    ".zip": ["application/zip", "application/x-zip-compressed"],
    ".dwg": ["application/acad", "application/x-acad", "application/autocad_dwg", "image/vnd.dwg", "image/x-dwg"],
    ".dxf": ["application/dxf", "application/x-dxf", "image/vnd.dxf"],
    ".jpg": ["image/jpeg"],
    ".png": ["image/png"],
    ".gif": ["image/gif"],
    ".bmp": ["image/bmp"],
    ".webp": ["image/webp"],
    ".tif": ["image/tiff"],
    ".heic": ["image/heic"],
    ".rtf": ["application/rtf", "text/rtf"],
    ".txt": ["text/plain"],
    ".csv": ["text/csv"],
}
#: Hexadecimal starts of files, in order.
MAGIC = [
    ("25504446", ".pdf"), ("504B0304", ".docx"), ("FFD8FF", ".jpg"), ("89504E470D0A1A0A", ".png"), ("474946383761", ".gif"), ("474946383961", ".gif"),
    ("49492A00", ".tif"), ("4D4D002A", ".tif"), ("7B5C727466", ".rtf"), ("D0CF11E0A1B11AE1", ".doc"),
]
NOT_FILES = ["application/json", "text/json", "application/javascript", "text/javascript", "application/x-msdownload", "application/vnd.microsoft.portable-executable"]
HTML_STARTS = ["<!doctype html", "<html", "<head", "<body"]

# --- fixed values: reference patterns by dialect, and dates ------------------------------------------------------------
REFERENCES = {
    "generic": r"(?i)\b\d{2,4}[/.-][A-Z0-9/.-]+\b",
    "forms": r"(?i)\b(?:[A-Z]{1,6}/\d{2,4}/[A-Z0-9/.-]+|[A-Z]{1,6}\d{2,4}/\d{3,6}[A-Z/.-]*|\d{2,4}/\d{3,6}/[A-Z0-9.-]+|\d{2,4}/\d{4,6})\b",
    "northgate": r"(?i)\b[A-Z]{1,12}[./-]\d{2,4}[/.-][A-Z0-9/.-]+\b",
    "ocella": r"(?i)\b\d{2,4}[/.-][A-Z0-9/.-]+\b",
    "idox": r"(?i)\b(?:[A-Z]{1,8}\d{2,4}/[A-Z0-9.-]+(?:/[A-Z0-9.-]+)*|[A-Z]{1,8}/\d{2,4}/[A-Z0-9.-]+(?:/[A-Z0-9.-]+)*|\d{2,4}/[A-Z0-9.-]+(?:/[A-Z0-9.-]+)*)\b",
}
POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
#: Day-first formats after the weekday is cut off, in order; two-digit years turn at 69.
DATE_FORMATS = ["d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy", "yyyy-M-d", "d-MMMM-yyyy", "d-MMM-yyyy", "d MMMM yyyy", "d MMM yyyy"]

# --- fixed values: patterns of page texts, scripts and addresses -------------------------------------------------------
#: A date as listings and document tables show it, numeric or with its weekday.
SHOWN_DATE = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{4}|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{1,2}\s+\w+\s+\d{4})"
REFERENCE_LABEL = r"\b(?:Ref(?:erence)?\.?\s*(?:No\.?)?|Application\s+(?:No\.?|Number|Reference))\s*:\s*"
ROW_LABELS = r"(?i)\b(Application|Reference|Validated|Received|Status)\b:?"
NUMBER_PREFIX = r"(?i)^Application(?:\s+(?:No\.?|Number))?\s*[:.]?\s*"
HYPHEN_FORMAT = r"(?i)format\s+DD-MM-YYYY"
RESULT_CAP = r"(?i)\bfirst\s+(\d+)\s+results?\s+shown,\s+there\s+are\s+(\d+)\s+in\s+total\b"
RESULT_TOTAL = r"(?i)\bRecords\s+\d+\s+to\s+\d+\s+of\s+(\d+)\b"
REPORTED_COUNT = r"(?i)\bPlanning\s*\((\d+)\)"
ROW_DATE = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
CARD_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
TABLE_NUMBER = r"(?i)Application number\s*:\s*(\S+)"
TABLE_DATE = r"(?i)Registered\s*:\s*(\d{1,2}/\d{1,2}/\d{4})"
AFTER_AT = r"(?is)^.*?\s+at\s+(.*)$"
DETAIL_PATH = "(?i)/(?:planning/)?(?:display|application|details?)/([A-Z0-9][A-Z0-9/.-]{3,})/?$"
DISPLAY_PATH = "(?i)/Planning/Display/(.+?)/?$"
RECORD_PATH = "(?i)/s/(?:papplication|planning-application|detail)/([^/?#]+)"
PREFIX_PATH = "(?i)^(.+?)/s/"
BOOT_SCRIPT = "/s/sfsites/l/([^/]+)/(?:inline|bootstrap)\\.js"
#: Settings in scripts: patterns in order.
SCRIPT_SETTINGS = {
    "api_url": [r"Civica\.APIUrl\s*=\s*[\"']([^\"']+)[\"']"],
    "ref_type": [r'"PlanningApplicationRefType"\s*:\s*"([^"]+)"', r"RefType\s*:\s*[\"']([^\"']+)[\"']"],
    "viewer": [r"Civica\.KeyObjectViewerUrl\s*=\s*[\"']([^\"']+)[\"']"],
    "form_uri": [r'"publish-uri"\s*:\s*"([^"]+)"', r"form_uri=([^\"'&]+)"],
    "document_list": [r'"url"\s*:\s*"([^"]*getDocumentList[^"]*)"'],
    "context": [r"\bvar\s+ctx\s*=\s*['\"]([^'\"]+)['\"]"],
}
LEGACY_PAGES = ["wphappsearchres.displayresultsurl", "startindex="]
#: Texts after a label that are no value of it.
NOT_VALUES = ["select_your_property", "find_your_nearest"]
VIEWER_PATH = "/my-requests/keyobject-viewer/"
IDOX_ROOT = "/online-applications/"
HOSTED_REGISTERS = "planning.agileapplications.co.uk"
COMMON_LABELS = ["", "www", "planning"]
DATED_SEARCH, DATED_FIELD = "copeland.gov.uk/planning/application-search", "field_plan_app_date_received_value"
VALID_SEARCH = "status=2&dateType=valid"
BRIDGE, FIELD_DOWNLOAD = "runthirdpartysearch", "fa=downloaddocument"
STORE_QUERY = [("currentPageIndex", "0"), ("IsDatePublishSortedDescending", "false"), ("pageSize", "1000")]
#: Pages or records that a family's search reads at most.
CAPS = [("aggregator", 100), ("idox", 100), ("tascomi", 250), ("colchester", 250), ("northgate", 500), ("agile", 50), ("kensington", 100_000)]
