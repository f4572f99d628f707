"""Fixed values of the scan semantics.

Everything in this module is data that results depend on: word lists, weights,
thresholds and patterns. Nothing here is computed.
"""

# --- Fixed values: severities, categories, scoring -------------------------

SEVERITIES = ["critical", "high", "medium", "low"]

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

SEVERITY_WEIGHT = {"critical": -20, "high": -10, "medium": -5, "low": -2}

CATEGORY_MULTIPLIER = {
    "secret": 1.5,
    "frontend_exposure": 1.3,
    "auth": 1.2,
    "authorization": 1.1,
    "validation": 1.0,
    "dependency": 0.8,
    "code_quality": 0.5,
    "structure": 0.3,
}

CATEGORIES = [
    "secret",
    "auth",
    "authorization",
    "frontend_exposure",
    "validation",
    "dependency",
    "code_quality",
    "structure",
]

DANGER_BELOW = 40
WARNING_BELOW = 70

FIX_MINUTES = {"critical": 15, "high": 10, "medium": 5, "low": 5}

# --- Fixed values: scan defaults and thresholds -----------------------------

DEFAULT_MAX_FILES = 5000
DEFAULT_MIN_SEVERITY = "low"
DEFAULT_TIMEOUT_MS = 30000
MAX_FILE_LINES = 500
MAX_ANY_USES = 20
MAX_DIRECT_DEPENDENCIES = 80
DEBOUNCE = "1500 milliseconds"

# --- Fixed values: file selection --------------------------------------------

SCANNABLE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]

SCANNABLE_NAMES = [
    ".env",
    ".env.local",
    ".env.example",
    ".env.sample",
    ".env.development",
    ".env.production",
    ".env.staging",
    ".gitignore",
    "package.json",
    "package-lock.json",
    "pnpm-lock.yaml",
    "yarn.lock",
]

EXCLUDED_DIRS = [
    "node_modules",
    ".git",
    ".svn",
    "dist",
    "build",
    "out",
    ".next",
    ".nuxt",
    ".turbo",
    ".vercel",
    "coverage",
    ".nyc_output",
    "storybook-static",
    ".cache",
    "tmp",
    "temp",
]

CODE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
MODULE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]

# --- Fixed values: route and content markers ----------------------------------

RISKY_ROUTES = [
    "/admin",
    "/users",
    "/payment",
    "/billing",
    "/settings",
    "/dashboard",
    "/api/users",
    "/api/admin",
]

ADMIN_ROUTES = ["/admin", "/superuser", "/manage", "/moderat"]

MUTATING_METHODS = ["POST", "PUT", "PATCH", "DELETE"]

AUTH_MARKERS = [
    "getServerSession",
    "await auth()",
    "import { auth }",
    "supabase.auth.getUser",
    "supabase.auth.getSession",
    "verifyToken",
    "jwt.verify",
    "requireAuth",
    "checkAuth",
    "isAuthenticated",
]

AUTHZ_MARKERS = [
    "isAdmin",
    "role",
    "hasPermission",
    "permissions",
    "ownerId",
    "user.id ===",
    "userId ===",
    "req.user.id",
    "session.user.id",
    "canAccess",
    "authorize",
]

BODY_READS = ["req.json()", "request.json()", "req.body"]

VALIDATION_LIBRARIES = [
    "zod",
    "yup",
    "joi",
    "valibot",
    "superstruct",
    "io-ts",
    "class-validator",
]

VALIDATION_CALLS = [
    ".parse(",
    ".safeParse(",
    ".validate(",
    ".validateSync(",
    ".validateAsync(",
]

CLIENT_DIRECTIVES = ['"use client"', "'use client'"]
SERVER_DIRECTIVES = ['"use server"', "'use server'"]
ADMIN_KEY_MARKERS = ["SERVICE_ROLE_KEY", "service_role"]

# --- Fixed values: patterns -----------------------------------------------------

PUBLIC_SECRET_PATTERN = r"(?i)NEXT_PUBLIC_[A-Z_]*(?:SECRET|PRIVATE|PASSWORD|SERVICE_ROLE)[A-Z_]*"

LOCAL_HOST_PATTERN = r"(?i)(?<!\w)(?:localhost|127\.0\.0\.1|\[?::1\]?|10\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)|192\.168\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)|172\.(?:1[6-9]|2\d|3[01])\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w)"

# Every match of LOCAL_HOST_PATTERN but the name holds at least one of these.
LOCAL_NUMBER_HINTS = ["127.0.0.1", "::1", "10.", "192.168.", "172."]

# --- Fixed values: manifests and project files --------------------------------

LIFECYCLE_SCRIPTS = ["preinstall", "postinstall", "install"]
TEST_RUNNERS = ["jest", "vitest", "mocha", "cypress", "playwright"]

# --- Fixed values: white space stripped from the ends of a line ------------------
# The white space and line terminators of ECMAScript.

TRIM_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# --- Fixed values: texts written by the fixes ------------------------------------

NEW_GITIGNORE = "node_modules\n.env\n.env.*\n"
GITIGNORE_ADDITION = ".env\n.env.*\n"
CALL_TO_COMMENT = "console.log"
COMMENTED_CALL = "/* console.log */"
