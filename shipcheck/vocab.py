"""Fixed values of the domain: lists, maps and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: result vocabulary
FIELDS = ["shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg"]
CATEGORIES = ["BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "SPAM", "GENERAL"]
STATUSES = ["OK", "MISMATCH", "NEEDS_REVIEW"]
REVIEW_REASONS = ["missing_attachment", "wrong_doc_type", "unreadable", "missing_value"]

# --- fixed values: input synonyms, first non-null wins
EMAIL_KEYS = {
    "email_id": ["email_id", "id", "emailId", "message_id", "messageId"],
    "subject": ["subject", "title"],
    "body": ["body", "text", "content", "message"],
    "sender": ["sender", "from", "from_address", "fromAddress"],
}
ATTACHMENT_LIST_KEYS = ["attachments", "attachment_paths", "attachment_refs", "files", "documents"]
SINGLE_ATTACHMENT_KEYS = [
    "si_attachment", "si_attachment_path", "si_path", "si_file", "si_document", "shipping_instruction", "shipping_instruction_path",
    "bl_attachment", "bl_attachment_path", "bl_path", "bl_file", "bl_document", "bill_of_lading", "bill_of_lading_path",
]
ATTACHMENT_ID_KEYS = ["attachment_ids", "attachmentIds"]
FILENAME_KEYS = ["filename", "name", "file_name", "path", "file_path"]
SOURCE_KEYS = ["path", "file_path", "file", "attachment_path", "url", "id"]
INLINE_TEXT_KEYS = ["content", "text", "plain_text", "plainText"]
BASE64_KEYS = ["content_base64", "base64", "data_base64"]
TYPE_HINT_KEYS = ["document_type", "type", "kind", "content_type", "mime_type"]
WRAPPER_KEYS = ["emails", "inbox", "messages", "data"]
INDEX_KEYS = ["id", "attachment_id", "path", "filename", "name"]
OFFICE_SUFFIXES = [".docx", ".xlsx", ".xlsm", ".pdf"]
TEMPLATE_NAME = "sample_submission.json"
DEFAULT_FILENAME = "unnamed_attachment.txt"

# --- fixed values: classification terms (folded, in report order)
SI_TERMS = ["shipping instruction", "shipping instructions", "shipper instruction", "shipper s instruction", "si"]
BL_TERMS = ["bill of lading", "ocean bill", "draft bl", "draft bill", "bl", "bol"]
COMPARISON_TERMS = ["compare", "comparison", "verify", "verification", "check", "review", "cross check", "match", "mismatch", "discrepancy", "difference", "validate"]
COMPARISON_PHRASES = ["si vs bl", "si versus bl", "shipping instruction against", "bill of lading against", "document comparison", "compare documents"]
BL_CONVERSATION = ["to confirm docs", "check docs", "draft bl", "bl draft", "request bl draft", "amend bl", "verify bl", "confirm bl"]
CURRENT_ACTIONS = ["compare", "verify", "check", "review", "confirm", "validate", "cross check"]
REQUEST_MARKERS = ["please", "kindly", "can you", "could you", "need you to", "request", "required"]
CURRENT_DOCUMENTS = ["si", "shipping instruction", "bl", "bill of lading", "draft bl", "draft bill", "document", "documents", "docs"]
SI_REQUESTS = ["new si", "new shipping instruction", "create si", "prepare si", "submit si", "issue si", "amend si", "update si", "shipping instruction request", "request shipping instruction"]
REQUEST_TERMS = ["please", "request", "need", "provide", "prepare", "create", "submit", "issue", "amend"]
INVOICE_TERMS = ["invoice", "commercial invoice", "proforma", "billing", "payment", "remittance", "credit note", "debit note", "freight charge"]
SPAM_ACCOUNT = ["verify your account", "account verification", "confirm your account", "account suspended", "unusual account activity"]
SPAM_CREDENTIAL = ["password", "credential", "login", "sign in", "security code"]
SPAM_URGENCY = ["immediately", "act now", "urgent action", "within 24 hours", "final warning"]
SPAM_LINK = ["click here", "click the link", "payment link", "redirect"]
SPAM_SUSPICIOUS = ["bit ly", "tinyurl", "shorturl", "xyz", "top", "click"]
SPAM_PRIZE = ["lottery", "you have won", "winner", "claim your prize", "free gift"]
SPAM_PROMOTION = ["limited time offer", "exclusive offer", "unrealistic discount"]
SPAM_INVESTMENT = ["crypto", "cryptocurrency", "guaranteed return", "guaranteed returns", "get rich quick", "earn money fast"]
SPAM_INVESTMENT_STRONG = ["guaranteed return", "guaranteed returns", "get rich quick", "earn money fast"]
SPAM_CRYPTO, SPAM_PAYMENT = ["crypto", "cryptocurrency"], ["invoice", "payment"]
SPAM_CONTEXT = ["bitcoin", "crypto", "cryptocurrency", "investment opportunity"]

GUARANTEED_RETURN = r"\bguaranteed\s+\d{2,4}\s*(?:percent\s+)?(?:return|returns)\b"
EXTREME_DISCOUNT = r"\b(?:9[0-9]|100)\s*(?:percent|off)\b"

# --- fixed values: letters whose case folding differs from lower-casing, where it matters after folding to [a-z0-9]
FOLD_PAIRS = [
    ("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ŉ", " n"), ("ǰ", "j "), ("ẖ", "h "), ("ẗ", "t "), ("ẘ", "w "), ("ẙ", "y "), ("ẚ", "a "),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
]

# --- fixed values: document titles (Java patterns, used with (?iU) on the first 2000 characters: white space and word ends as Unicode has them)
SI_TITLES = [
    (r"\bshipping\s+instructions?\b", "content heading: shipping instruction", 10),
    (r"\bshipper'?s\s+instructions?\b", "content heading: shipper instruction", 10),
    (r"\bbill\s+of\s+lading\s+instructions?\b", "content heading: bill of lading instruction", 14),
    (r"\bbl\s+instructions?\b", "content heading: BL instruction", 14),
    (r"\bb\s*/\s*l\s+instructions?\b", "content heading: B/L instruction", 14),
]
BL_TITLES = [(r"\bbill\s+of\s+lading\b", "content heading: bill of lading"), (r"\bocean\s+bill\b", "content heading: ocean bill")]
OTHER_TITLES = [
    (r"^\s*(?:commercial\s+|proforma\s+)?invoice\b", "content heading: invoice"),
    (r"^\s*packing\s+list\b", "content heading: packing list"),
    (r"^\s*certificate\s+of\s+origin\b", "content heading: certificate of origin"),
]
SI_FILENAME = r"(?iU)(?:^|[_\-\s.])(?:si|shipping[_\-\s]?instruction)(?:$|[_\-\s.])"
BL_FILENAME = r"(?iU)(?:^|[_\-\s.])(?:bl|bol|bill[_\-\s]?of[_\-\s]?lading)(?:$|[_\-\s.])"
UNREADABLE_SUFFIXES = [".doc", ".xls", ".png", ".jpg", ".jpeg", ".tif", ".tiff"]

# --- fixed values: label aliases of the seven fields (case-insensitive patterns)
LABELS = {
    "shipper": [r"shipper\s*\(\s*principal\s+or\s+seller\s*\)", r"shipper\s*(?:name\s*(?:and|&)\s*address)?", r"shipper(?:\s*(?:name|details|address))?", r"shipper\s*/\s*exporter", r"exporter", r"sender"],
    "consignee": [r"consignee\s*\(\s*non[-\s]?negotiable\s*\)", r"consignee\s*(?:name\s*(?:and|&)\s*address)?", r"consignee(?:\s*(?:name|details|address))?", r"consigned\s+to", r"to\s+the\s+order\s+of", r"receiver"],
    "notify_party": [r"notify\s+party\s*/\s*intermediate\s+consignee", r"notify\s+party\s*(?:name\s*(?:and|&)\s*address)?", r"notify\s+party(?:\s*(?:name|details|address))?", r"party\s+to\s+notify", r"notify(?:\s+address)?"],
    "port_of_loading": [r"port\s+of\s+loading\s*\(\s*pol\s*\)", r"port\s+of\s+loading", r"load(?:ing)?\s+port", r"port\s+of\s+load", r"place\s+of\s+loading", r"port\s+load", r"p\.?\s*o\.?\s*l\.?", r"pol"],
    "port_of_discharge": [r"port\s+of\s+discharge\s*\(\s*pod\s*\)", r"port\s+of\s+discharge", r"port\s+of\s+unloading", r"discharge\s+port", r"unloading\s+port", r"place\s+of\s+discharge", r"p\.?\s*o\.?\s*d\.?", r"pod"],
    "container_count": [r"(?:no\.?|number)\s*of\s*containers?\s+or\s+packages?", r"total\s+(?:no\.?|number)?\s*of\s*containers?", r"number\s+of\s+containers?", r"(?:no\.?|number)\s*of\s*containers?", r"container\s+count", r"total\s+containers?", r"containers?"],
    "gross_weight_kg": [r"total\s+gross\s+(?:weight|wt\.?)\s*(?:\([^)]*\))?", r"gross\s+weight[^\s:()]*\s*\(\s*kg(?:s)?\s*\)", r"gross\s+(?:weight|wt\.?)\s*\([^)]*\)", r"gross\s+weight\s*(?:\(?\s*kg(?:s)?\s*\)?)?", r"total\s+gross\s+weight", r"gross\s+(?:weight|wt\.?)", r"g\.?\s*w\.?"],
}
BOUNDARY = r"(?iU)^(?:ocean\s+vessel|export\s+carrier|vessel(?:\s*,?\s*voyage)?|container\s+(?:no\.?|number)|description|commodity|cargo\s+description|goods\s+description)\b"
BARE_WEIGHT = r"(?iU)^[0-9][0-9,.\s]*(?:kg|kgs|kilograms?)?$"
KIND_EVIDENCE = {
    "si": r"(?iU)\b(?:shipping\s+instruction|shipper'?s\s+instruction|bill\s+of\s+lading\s+instruction|bl\s+instruction|b\s*/\s*l\s+instruction|si)\b",
    "bl": r"(?iU)\b(?:bill\s+of\s+lading|ocean\s+bill|b\s*/\s*l|bol)\b",
}
INSTRUCTION_TITLE = r"(?iU)\b(?:bill\s+of\s+lading|bl|b\s*/\s*l)\s+instruction\b"
PLACEHOLDER = r"(?iU)^(?:tba|tbd|n\s*/?\s*a|nil|unknown|pending|to\s+be\s+(?:advised|confirmed)|[-_]+|_+\s*(?:kg|kgs|kilograms?|mt|mts|metric\s*tons?))$"
THREAD_BOUNDARY = r"(?iU)^\s*(?:>{1,}|[-_ ]{3,}(?:original\s+message|forwarded\s+message)[-_ ]{3,}|from:\s|on\s+.+\s+wrote:)"

# --- fixed values: party references, numbers and units (Java patterns, on lower-cased text; white space and word ends as Unicode has them)
SAME_AS_CONSIGNEE, CONSIGNEE_MARK = ["same as consignee", "same as cnee"], "__same_as_consignee__"
SAME_AS_SHIPPER, SHIPPER_MARK = ["same as shipper", "same as exporter"], "__same_as_shipper__"
WEIGHT_NUMBER = r"(?U)[-+]?[0-9][0-9\s,.]*"
WEIGHT_UNITS = [
    ("kg", r"(?U)\b(?:kg|kgs|kilogram|kilograms|kilo)\b"), ("mt", r"(?U)\b(?:mt|mts|metric\s*ton(?:ne)?s?)\b"),
    ("lb", r"(?U)\b(?:lb|lbs|pound|pounds)\b"), ("ambiguous", r"(?U)\b(?:ton|tons|tonne|tonnes)\b"),
]
POUND_KG = "0.45359237"
CONTAINER_PARTS = r"(?U)\b([0-9]+)\s*(?:x|×)\s*(?:[0-9]{2,3}(?:\s*['\"]?\s*(?:gp|hc|hq|dv|rf|ot|ft))?|containers?)"
CONTAINER_TOTAL = r"(?U)\b([0-9]+)\s*(?:containers?|cntrs?|units?)\b"

# --- fixed values: normalisation maps
LEGAL_WORDS = {
    "co": "company", "corp": "corporation", "inc": "incorporated", "ltd": "limited", "llc": "limited liability company", "plc": "public limited company", "pte": "private", "pvt": "private",
}
PORT_ALIASES = {
    "cns ha": "shanghai", "cnsha": "shanghai", "shanghai china": "shanghai", "uslax": "los angeles", "los angeles usa": "los angeles", "sgsin": "singapore", "singapore singapore": "singapore",
    "nlrtm": "rotterdam", "rotterdam netherlands": "rotterdam", "deham": "hamburg", "hamburg germany": "hamburg", "aumed": "melbourne", "mymyp": "port klang", "port kelang": "port klang",
}
NUMBER_WORDS = {w: i for i, w in enumerate(["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"])}

# --- fixed values: template keys
TEMPLATE_KEYS = {
    "email_id": ["email_id", "id"], "category": ["category", "classification", "email_category", "email_type"], "status": ["status", "comparison_status", "result"],
    "has_defect": ["has_defect", "mismatch_found", "has_mismatch", "mismatch_detected"], "defect_fields": ["defect_fields", "mismatched_fields", "mismatch_fields", "defects"],
    "review_reason": ["review_reason", "review_code", "needs_review_reason"],
}
#: Names of the fields for people.
DISPLAY = {
    "shipper": "shipper", "consignee": "consignee", "notify_party": "notify party", "port_of_loading": "port of loading", "port_of_discharge": "port of discharge",
    "container_count": "container count", "gross_weight_kg": "gross weight in kilograms",
}
