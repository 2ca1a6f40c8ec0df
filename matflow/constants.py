"""Fixed domain values.

Everything in the block below must equal the values of the application this
engine re-implements; they are stated plainly and in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the source application)
# ---------------------------------------------------------------------------

# stock bands: quantite < 10 -> CRITIQUE, quantite < 50 -> FAIBLE, else OK
CRITICAL_STOCK = 10
LOW_STOCK = 50
STATE_CRITICAL = "CRITIQUE"
STATE_LOW = "FAIBLE"
STATE_OK = "OK"

# colour bands of the top-10 stock chart (same thresholds)
COLOUR_CRITICAL = "rouge"
COLOUR_LOW = "orange"
COLOUR_OK = "bleu"

# fill gauge: 200 units = 100 %
FILL_REFERENCE = 200
LEVEL_LOW = "low"
LEVEL_MEDIUM = "medium"
LEVEL_HIGH = "high"

# production statuts, in the order of the CHECK constraint
STATUTS = ["En cours", "Terminé", "En attente", "Critique", "En retard"]
DEFAULT_STATUT = "En cours"
FINISHED_STATUT = "Terminé"
ALERT_STATUTS = ["Critique", "En retard"]

# statut -> display class
STATUS_CLASSES = {
    "En cours": "s-encours",
    "Terminé": "s-termine",
    "En attente": "s-attente",
    "Critique": "s-critique",
    "En retard": "s-retard",
}
STATUS_CLASS_DEFAULT = ""

# role -> label
ROLES = ["admin", "responsable", "chef_equipe", "lecteur"]
DEFAULT_ROLE = "lecteur"
ROLE_LABELS = {
    "admin": "Administrateur",
    "responsable": "Responsable Production",
    "chef_equipe": "Chef d'équipe",
    "lecteur": "Lecteur",
}
# (the source shows its product name here; this engine takes it as a parameter)
ROLE_LABEL_DEFAULT = "Application"

# role x resource -> allowed actions
PERMISSIONS = {
    "admin": {
        "stock": ["CREATE", "READ", "UPDATE", "DELETE"],
        "production": ["CREATE", "READ", "UPDATE", "DELETE"],
        "users": ["CREATE", "READ", "UPDATE", "DELETE"],
        "stats": ["READ"],
    },
    "chef_equipe": {
        "stock": ["READ", "UPDATE"],
        "production": ["CREATE", "READ", "UPDATE"],
        "users": [],
        "stats": ["READ"],
    },
    "responsable": {
        "stock": ["READ"],
        "production": ["CREATE", "READ", "UPDATE"],
        "users": [],
        "stats": [],
    },
    "lecteur": {
        "stock": ["READ"],
        "production": ["READ"],
        "users": [],
        "stats": [],
    },
}

# role x resource -> actions as the route guards check them (they differ
# from the table above: chef_equipe may create materials, any signed-in role
# may update or delete jobs, statistics are for admin and chef_equipe)
ROUTE_PERMISSIONS = {
    "admin": {
        "stock": ["CREATE", "READ", "UPDATE", "DELETE"],
        "production": ["CREATE", "READ", "UPDATE", "DELETE"],
        "stats": ["READ"],
    },
    "chef_equipe": {
        "stock": ["CREATE", "READ", "UPDATE"],
        "production": ["CREATE", "READ", "UPDATE", "DELETE"],
        "stats": ["READ"],
    },
    "responsable": {
        "stock": ["READ"],
        "production": ["CREATE", "READ", "UPDATE", "DELETE"],
    },
    "lecteur": {
        "stock": ["READ"],
        "production": ["READ", "UPDATE", "DELETE"],
    },
}

# log-in lockout: the 6th failure locks the account for 20 minutes
MAX_FAILURES = 6
LOCK_MINUTES = 20

# rate limits: 100 requests per 15 minutes, 10 failed log-ins per 15 minutes
RATE_WINDOW = "15 minutes"
RATE_LIMIT = 100
LOGIN_RATE_LIMIT = 10

# audit retention in days
AUDIT_RETENTION_DAYS = 365

# author of trigger rows when no updated_by is set
SYSTEM_USER = "SYSTEM"

# text for a missing date or amount in reports
MISSING_TEXT = "—"
CURRENCY = "MAD"
# French thousands separator (narrow no-break space) and decimal comma
FR_GROUP = "\u202f"
FR_DECIMAL = ","

# NOT NULL columns of the four tables (statut is covered by its CHECK rule)
STOCK_NOT_NULL = ["materiel", "quantite", "date_ajout", "created_at"]
PRODUCTION_NOT_NULL = ["produit", "quantite", "responsable", "date_prod", "cout", "qte_consommee", "created_at"]
USERS_NOT_NULL = ["username", "role", "tentatives", "created_at", "actif"]
AUDIT_NOT_NULL = ["utilisateur", "action", "table_name", "record_id", "timestamp"]

# audit actions and table names
ACTION_CREATE = "CREATE"
ACTION_UPDATE = "UPDATE"
ACTION_DELETE = "DELETE"
ACTION_LOGIN = "LOGIN"
ACTION_LOGOUT = "LOGOUT"
TABLE_STOCK = "Stock"
TABLE_PRODUCTION = "Production"

# columns written into the audit JSON by the change capture
STOCK_AUDIT_COLUMNS = ["materiel", "quantite", "date_ajout"]
PRODUCTION_AUDIT_COLUMNS = [
    "produit", "quantite", "responsable", "date_prod",
    "cout", "statut", "stock_id", "qte_consommee",
]

# ---------------------------------------------------------------------------
# Fixture mapping (FIXTURES.md): how the driver tables stand for the domain
# ---------------------------------------------------------------------------
FIXTURE_DATE_ORIGIN = "1995-01-01"
PRIORITY_TO_STATUT = {
    "1-URGENT": "Critique",
    "2-HIGH": "En retard",
    "3-MEDIUM": "En cours",
    "4-NOT SPECIFIED": "En attente",
    "5-LOW": "Terminé",
}
SEGMENT_TO_ROLE = {
    "AUTOMOBILE": "admin",
    "BUILDING": "responsable",
    "FURNITURE": "chef_equipe",
}
EVENT_TO_ACTION = {
    "signup": "CREATE",
    "purchase": "UPDATE",
    "error": "DELETE",
    "click": "LOGIN",
    "view": "LOGOUT",
}
LOGIN_FAILURE_EVENTS = ["error", "view", "click"]
SERVER_ERROR_EVENT = "error"
