"""Word lists, lookup tables and patterns of government orders.

FIXED VALUES: results depend on these, in this order; they are data, not choices of this library.
"""

from __future__ import annotations

DEPARTMENTS = (
    "Adi Dravidar and Tribal Welfare", "Agriculture and Farmers Welfare", "Animal Husbandry, Dairying and Fisheries",
    "Backward Classes, Most Backward Classes and Minorities Welfare", "Commercial Taxes and Registration",
    "Co-operation, Food and Consumer Protection", "Energy", "Environment, Climate Change and Forests", "Finance",
    "Handlooms, Handicrafts, Textiles and Khadi", "Health and Family Welfare", "Higher Education", "Highways and Minor Ports",
    "Home, Prohibition and Excise", "Housing and Urban Development", "Industries, Investment Promotion and Commerce",
    "Information Technology and Digital Services", "Labour Welfare and Skill Development", "Law", "Micro, Small and Medium Enterprises",
    "Municipal Administration and Water Supply", "Personnel and Administrative Reforms", "Planning, Development and Special Initiatives",
    "Public", "Public Works", "Revenue and Disaster Management", "Rural Development and Panchayat Raj", "School Education",
    "Social Welfare and Women Empowerment", "Tamil Development and Information", "Tourism, Culture and Religious Endowments",
    "Transport", "Water Resources", "Youth Welfare and Sports Development",
)
DISTRICTS = (
    "Ariyalur", "Chengalpattu", "Chennai", "Coimbatore", "Cuddalore", "Dharmapuri", "Dindigul", "Erode", "Kallakurichi", "Kancheepuram",
    "Kanniyakumari", "Karur", "Krishnagiri", "Madurai", "Mayiladuthurai", "Nagapattinam", "Namakkal", "Nilgiris", "Perambalur",
    "Pudukkottai", "Ramanathapuram", "Ranipet", "Salem", "Sivaganga", "Tenkasi", "Thanjavur", "Theni", "Thoothukudi", "Tiruchirappalli",
    "Tirunelveli", "Tirupathur", "Tiruppur", "Tiruvallur", "Tiruvannamalai", "Tiruvarur", "Vellore", "Viluppuram", "Virudhunagar",
)
DISTRICT_ALIASES = {
    "kanyakumari": "Kanniyakumari", "tuticorin": "Thoothukudi", "trichy": "Tiruchirappalli", "tiruchirapalli": "Tiruchirappalli",
    "the nilgiris": "Nilgiris", "villupuram": "Viluppuram", "vilupuram": "Viluppuram", "tirupur": "Tiruppur", "sivagangai": "Sivaganga",
    "tiruvanamalai": "Tiruvannamalai",
}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7,
    "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
SERIES = {"MS": "Ms", "RT": "Rt", "D": "D", "P": "P", "2D": "2D"}
UNITS = {"crore": 10_000_000, "crores": 10_000_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "thousand": 1_000}
BUCKETS = (
    ("health", "health"), ("family welfare", "health"), ("school education", "education"), ("higher education", "education"),
    ("education", "education"), ("public works", "public_works"), ("rural development", "rural_development"), ("panchayat raj", "rural_development"),
)
BUCKET_TARGETS = {"health": 50, "education": 50, "public_works": 50, "rural_development": 50}
BACKEND_CEILINGS = {"pymupdf": 1.0, "pdfplumber": 0.97, "pypdf": 0.90}
REGION_WEIGHTS = {
    "go_number": {"header": 1.0, "references": 0.22, "body": 0.55},
    "go_date": {"header": 1.0, "references": 0.22, "body": 0.55},
    "department": {"header": 1.0, "references": 0.45, "body": 0.70},
}
CORE_FIELDS = ("go_number", "go_date", "department", "subject")
ALL_FIELDS = (*CORE_FIELDS, "budget", "district", "scheme_name")
ACCURACY_TARGETS = {"go_number": 0.99, "go_date": 0.99, "department": 0.98, "subject": 0.95, "budget": 0.95, "district": 0.95, "scheme_name": 0.90}
EGRESS_CAUSES = ("DNS_RESOLUTION_FAILED", "TCP_CONNECTION_FAILED", "TLS_HANDSHAKE_FAILED", "CONNECT_TIMEOUT", "REMOTE_HOST_UNREACHABLE")
HEADER_HINTS = {
    "go_number": ("g.o", "go no", "order no", "number", "ms no"), "go_date": ("date",), "department": ("department", "dept"),
    "subject": ("subject", "abstract", "title", "description"),
}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
GO_NUMBER = r"(?i)\bG\.?\s*[O0]\.?\s*(?:[({]\s*(Ms|Rt|D|P|2D)\s*\.?\s*[)}]|(Ms|Rt|D|P)\s*\.)?[\s.,]*(?:No\.?|Number)?\s*([0-9]{1,5})(?:\s*[/,]?\s*((?:19|20)[0-9]{2}))?"
ORDER_NUMBER = r"(?i)\b(?:Order|Proceedings)\s+No\.?\s*([0-9]{1,5})"
DATE_PATTERNS = (
    ("DATE_NUMERIC_LABELLED", r"(?i)\b(?:Dated?|Date)\s*[:\-]?\s*([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*([0-9]{2,4})", 0.97),
    ("DATE_TEXTUAL_LABELLED", rf"(?i)\b(?:Dated?|Date)\s*[:\-]?\s*([0-9]{{1,2}})\s*(?:st|nd|rd|th)?\s*({_MONTH})\s*,?\s*([0-9]{{4}})", 0.97),
    ("DATE_NUMERIC_BARE", r"\b([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*((?:19|20)[0-9]{2})\b", 0.62),
    ("DATE_TEXTUAL_BARE", rf"(?i)\b([0-9]{{1,2}})\s*(?:st|nd|rd|th)?\s+({_MONTH})\s*,?\s*([0-9]{{4}})\b", 0.62),
)
DEPARTMENT_HEADING = r"(?m)^([A-Z][A-Z&.,'()\-/ ]{3,80}?)\s*(?:\([^()\n]{1,20}\)\s*)?DEPARTMENT\s*$"
DEPARTMENT_IN_ABSTRACT = r"([A-Z][A-Za-z&.,'()\-/ ]{3,80}?)\s+(?:\([^()\n]{1,20}\)\s+)?Department\b"
#: From a capital to the end of its run of such characters, if a match from there could be as long: one from a later capital of the run would begin at the first one too.
NO_DEPARTMENT = r"[A-Z][A-Za-z&.,'()\-/ ]{0,80}+(?![A-Za-z&.,'()\-/ ])"
ABSTRACT_BLOCK = r"(?ism)^\s*ABSTRACT\s*\n(.+?)(?=\n\s*(?:-{4,}|_{4,}|={4,}|(?-i:[A-Z][A-Z0-9&.,'()\-/ ]{3,80}?DEPARTMENT)\s*$|G\.?\s*[O0]\.?[\s.(]|READ\b))"
ORDERS_ISSUED = r"(?i)Orders?\s*[-–—]?\s*issued\.?"
MONEY = r"(?i)(?:Rs\.?|INR|₹|Rupees)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|lakhs?|lacs?|thousand)?\s*(?:/-)?"
SCHEME = (
    r"""(?:["'“‘])([A-Z][^"'”’\n]{5,90}?)(?:["'”’])|\b((?:[A-Z][A-Za-z'’.\-]*|of|and|for|the)"""
    r"""(?:\s+(?:[A-Z][A-Za-z'’.\-]*|of|and|for|the)){0,5}\s+(?:Scheme|Thittam|Mission|Yojana|Programme|Project))\b"""
)
SCHEME_KEYWORD = r"(?i)\b(Scheme|Thittam|Mission|Yojana|Programme|Project)\b"
READ_MARKER = r"(?im)^[ \t]*Read\s*[:\-]"
ORDER_MARKER = r"(?m)^[ \t]*ORDER\s*[:\-]"
TABLE_LINE = r"\S(?:[ \t]{2,}|\t)\S+(?:[ \t]{2,}|\t)\S"
PDF_HANDLER = r"(?i)(?:download|viewfile|getfile|fileview|attachment|/go/|documents?)"
ORDER_WORD = r"(?i)\b(?:g\.?o\.?|order|ms\.?\s*no|நிர்வாக|ஆணை)\b"
PAGINATION = r"(?i)(?:[?&](?:page|pageno|start|offset)=\d+)"
NEXT_TEXT = r"(?i)^\s*(?:next|»|>>|more|\d+)\s*$"
LISTING_PAGE = r"(?i)(?:godept_list|document_dept_list|go\.php|whatsnew\.php)"

#: What a reset empties; documents, sources, golden annotations and the audit log are never touched.
RESET = (
    "download_log", "saved_records", "saved_searches", "citizen_sessions", "citizen_users", "agent_sync_log", "extraction_requests", "escalations", "go_field_candidates", "go_fields", "calibration_snapshots", "extraction_failures",
    "certification_benchmark_runs", "go_records", "document_categories", "ocr_pages", "ocr_runs", "extraction_pages", "extractions", "crawl_evidences", "crawl_runs", "certification_jobs",
)

#: (phase, exception, root cause, confidence, stage that failed).
EXCEPTIONS = [
    ("url", "ValueError", "URL_VALIDATION_FAILED", "HIGH", "REQUEST_CREATED"), ("policy", "SourceRejected", "POLICY_BLOCKED", "HIGH", "POLICY_VALIDATION"),
    ("redirect", "SourceRejected", "REDIRECT_POLICY_BLOCKED", "HIGH", "REDIRECT_VALIDATION"),
    ("dns", "gaierror", "DNS_RESOLUTION_FAILED", "HIGH", "DNS_RESOLUTION"), ("dns", "TimeoutError", "DNS_RESOLUTION_FAILED", "MEDIUM", "DNS_RESOLUTION"),
    ("tcp", "ConnectionRefusedError", "TCP_CONNECTION_FAILED", "HIGH", "TCP_CONNECT"), ("tcp", "TimeoutError", "CONNECT_TIMEOUT", "MEDIUM", "TCP_CONNECT"),
    ("tcp", "HostUnreachable", "REMOTE_HOST_UNREACHABLE", "HIGH", "TCP_CONNECT"), ("tcp", "OSError", "TCP_CONNECTION_FAILED", "MEDIUM", "TCP_CONNECT"),
    ("tls", "SSLCertVerificationError", "TLS_HANDSHAKE_FAILED", "HIGH", "TLS_HANDSHAKE"),
    ("tls", "SSLError", "TLS_HANDSHAKE_FAILED", "HIGH", "TLS_HANDSHAKE"), ("tls", "TimeoutError", "CONNECT_TIMEOUT", "MEDIUM", "TLS_HANDSHAKE"),
    ("http", "ReadTimeout", "READ_TIMEOUT", "HIGH", "HTTP_RESPONSE_RECEIVED"), ("http", "RemoteProtocolError", "REMOTE_SERVER_DROPPED_CONNECTION", "HIGH", "HTTP_RESPONSE_RECEIVED"),
    ("http", "ConnectionResetError", "REMOTE_SERVER_DROPPED_CONNECTION", "HIGH", "HTTP_RESPONSE_RECEIVED"), ("http", "ConnectTimeout", "CONNECT_TIMEOUT", "LOW", "TCP_CONNECT"),
]
UNKNOWN = {"dns": ("DNS_RESOLUTION_FAILED", "DNS_RESOLUTION"), "tcp": ("TCP_CONNECTION_FAILED", "TCP_CONNECT"), "tls": ("TLS_HANDSHAKE_FAILED", "TLS_HANDSHAKE"), "http": ("UNKNOWN_FAILURE", "HTTP_REQUEST_SENT")}

#: (name, department, priority) of the sources that every registry begins with.
SEED_SOURCES = [
    ("Tamil Nadu GO Portal", "All Departments", "Critical"), ("Tamil Nadu Government Portal", "All Departments", "Critical"), ("Tamil Nadu Government Gazette", "Stationery and Printing", "Critical"),
    ("Health and Family Welfare Department", "Health and Family Welfare", "High"), ("School Education Department", "School Education", "High"), ("Rural Development Department", "Rural Development and Panchayat Raj", "High"),
    ("Public Works Department", "Public Works", "High"), ("Agriculture Department", "Agriculture and Farmers Welfare", "High"), ("Highways Department", "Highways and Minor Ports", "High"),
    ("Water Resources Department", "Water Resources", "High"), ("Municipal Administration Department", "Municipal Administration and Water Supply", "High"), ("Revenue Department", "Revenue and Disaster Management", "High"),
    ("Finance Department", "Finance", "High"), ("Housing Department", "Housing and Urban Development", "High"), ("Transport Department", "Transport", "High"),
    ("Industries Department", "Industries, Investment Promotion and Commerce", "High"), ("Environment Department", "Environment, Climate Change and Forests", "High"), ("Tourism Department", "Tourism, Culture and Religious Endowments", "High"),
    ("Labour Department", "Labour Welfare and Skill Development", "High"), ("Social Welfare Department", "Social Welfare and Women Empowerment", "High"),
    ("Animal Husbandry and Fisheries Department", "Animal Husbandry, Dairying, Fisheries and Fishermen Welfare", "High"), ("Energy Department", "Energy", "High"), ("Cooperation Department", "Co-operation, Food and Consumer Protection", "High"),
]

#: Names used in generated orders.
SCHEMES = ("Integrated Flood", "Rural Roads", "Free Breakfast", "Clean Rivers", "Skill Training")
