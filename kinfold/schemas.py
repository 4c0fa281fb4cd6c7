"""Fixed vocabularies and column sets of the state tables."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
IDENTIFIER_TYPES = ["EMAIL", "PHONE", "LOYALTY_ID", "ID_DOCUMENT", "EXTERNAL_KEY"]
BLOCK_KEY_TYPES = [
    "NAME_PHONETIC_BIRTHYEAR",
    "NAME_INITIALS_BIRTHDATE",
    "PHONE_SUFFIX7",
    "EMAIL_LOCALPART",
    "EMAIL_MASKED",
]
OBJECT_ROLES = ["PRIMARY_GUEST", "ADDITIONAL_GUEST", "BOOKER"]
RULE_MATCH_KINDS = ["EXACT", "EMAIL_DOMAIN"]
RULE_EFFECTS = ["IGNORE", "PERFECT_MATCH", "MASKED_ALIAS"]
RELAY_DOMAINS = [
    "guest.booking.com",
    "mchat.booking.com",
    "guest.airbnbmail.com",
    "reply.airbnb.com",
    "expediapartnercentral.com",
    "guest.expediamail.com",
    "guest.agoda.com",
    "mail.agoda.com",
    "guest.trip.com",
]
DEFAULT_REVIEW_THRESHOLD = 10
DEFAULT_AUTO_MERGE = "1.000"
DEFAULT_REVIEW_FLOOR = "0.750"
DETERMINISTIC_MATCHER = "deterministic-identifier-v1"
FUZZY_MATCHER = "fuzzy-rules-v1"
CREATE_MATCHER = "composite(deterministic-identifier-v1,fuzzy-rules-v1)"
UNMERGE_MATCHER = "manual-unmerge"
REVIEW_MATCHER = "manual-review"
REASON_BIRTHDATE = "birthdate: not an ISO date"
REASON_EMAIL = "email: not a valid email address"
REASON_PHONE = "phone: cannot be normalized to E.164"
REASON_DOCUMENT_PARTS = "idDocument: requires both type and number"
REASON_DOCUMENT_SHAPE = "idDocument: expected an object with type and number"
REASON_NO_IDENTIFIER = "no valid strong identifiers in record"
REASON_OBJECT_IDENTITY = "sourceObject: type and id are required"
REASON_ROLE_MISSING = "sourceObject.role: required"
REASON_ROLE_UNKNOWN = "sourceObject.role: not one of PRIMARY_GUEST, ADDITIONAL_GUEST, BOOKER"
REASON_VERSION = "sourceObject.version: missing or not a parseable instant"
REASON_START = "sourceObject.businessStart: not a parseable instant"
REASON_END = "sourceObject.businessEnd: not a parseable instant"
REASON_TIMESTAMP = "recordTimestamp: does not equal sourceObject.version"
SOURCE_CODE_PATTERN = "^[a-z0-9][a-z0-9-]*$"
# --- end of fixed values ----------------------------------------------------

# Ranks that put values in vocabulary order; the order decides which match or key comes first.
# Documents are extracted after external keys, but guest identifiers sort by this vocabulary.
IDENTIFIER_EXTRACTION_ORDER = ["EMAIL", "PHONE", "LOYALTY_ID", "EXTERNAL_KEY", "ID_DOCUMENT"]
