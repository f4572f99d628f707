"""The registered queries as SQL for DuckDB, written independently of the Spark code.

Shared parts are common table expressions: the derived corpus, the selected files, their
lines, the project contexts and the findings.
"""

from __future__ import annotations

from workload import corpus as K
from workload.queries import CAP, EXCLUDES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


TRIM = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim(col: str) -> str:
    return f"trim({col}, {lit(TRIM)})"


# --- corpus --------------------------------------------------------------------------------


def _template(t: str) -> str:
    a, b = t.split("{id}")
    return f"{lit(a)} || doc_id || {lit(b)}"


_PATH = " ".join(f"WHEN {k} THEN {_template(t)}" for k, t in K.PATHS.items())
_BODY = " ".join(f"WHEN {k} THEN {lit(t + chr(10))} || text" for k, t in K.SNIPPETS.items())
_MANY = ",".join(f'"dep{i}":"1.0.{i}"' for i in range(K.DEPENDENCY_COUNT))

CORPUS = f"""
docs AS (
  SELECT doc_id, text, source, CAST((doc_id // 20) % 16 AS INT) AS kind,
    CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS num, CAST(doc_id // 80 AS INT) AS grp
  FROM documents),
proj AS (
  SELECT *, CASE WHEN num < 6 THEN 'mono' ELSE source || '-' || grp END AS project_id,
    CASE WHEN num < 6 THEN 1 ELSE num + grp * 7 END AS s
  FROM docs),
doc_files AS (
  SELECT project_id, replace(CASE kind {_PATH} END, chr(92), '/') AS path,
    CASE kind {_BODY}
      WHEN 9 THEN repeat({lit(K.ANY_LINE)}, CAST(5 + doc_id % 5 * 5 AS INT)) || text
      WHEN 10 THEN repeat({lit(K.FILLER_LINE)}, CAST(493 + doc_id % 11 AS INT)) || text
      WHEN 13 THEN CASE WHEN doc_id % 3 = 1 THEN {lit(K.MUTED_FILE)} ELSE '' END
        || {lit(K.MUTED + chr(10))} || text
      WHEN 14 THEN '{{"scripts": {{"postinstall": "node x.js", "install": "make"}}, "about": "'
        || regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'),
          '[\\x00-\\x1F]', ' ', 'g') || '"}}'
    END AS content, doc_id, text
  FROM proj),
projects AS (SELECT DISTINCT project_id, s FROM proj),
root_files AS (
  SELECT project_id, 'package.json' AS path, CASE
    WHEN s % 20 = 13 THEN '{{"name": broken'
    WHEN s % 20 = 16 THEN '{{"scripts": "none", "dependencies": {{"next": ""}}}}'
    WHEN s % 20 = 18 THEN 'null'
    ELSE '{{"name":"app","scripts":{{' || CASE
        WHEN s % 5 = 2 THEN '"preinstall":"node pre.js","build":"tsc"'
        WHEN s % 5 = 3 THEN '"test:unit":"vitest run"' ELSE '"build":"tsc"' END
      || '}},"dependencies":{{' || CASE s % 4 WHEN 0 THEN '"next":"^14.0.0"'
        WHEN 1 THEN '"vite":"~5.1.0"' WHEN 2 THEN '"express":"4.18.2"' ELSE '"left":"1.0.0"' END
      || CASE WHEN s % 10 = 7 THEN {lit("," + _MANY)} ELSE '' END
      || '}},"devDependencies":{{' || CASE WHEN s % 2 = 0 THEN '"vitest":"1.0.0"' ELSE '' END
      || '}},"engines":{{"node":">=18"}}}}' END AS content
  FROM projects
  UNION ALL SELECT project_id, 'tsconfig.json', '{{}}' FROM projects WHERE s % 3 = 0
  UNION ALL SELECT project_id, '.gitignore', {lit(K.GITIGNORE)}
    || CASE WHEN s % 4 = 3 THEN {lit(K.GITIGNORE_ENV)} ELSE '' END FROM projects WHERE s % 2 = 1
  UNION ALL SELECT project_id, '.env', {lit(K.ENV_TEXT)} FROM projects WHERE s % 3 = 1
  UNION ALL SELECT project_id, '.env.example', 'DB_URL=' FROM projects WHERE s % 6 = 1
  UNION ALL SELECT project_id, 'README.md', '# app' FROM projects WHERE s % 5 = 0
  UNION ALL SELECT project_id, 'pnpm-lock.yaml', 'lock' FROM projects WHERE s % 7 = 0
  UNION ALL SELECT project_id, 'yarn.lock', 'lock' FROM projects WHERE s % 7 = 1)"""

RAW = """
raw_files AS (
  SELECT project_id, path, content FROM doc_files
  UNION ALL SELECT project_id, path, content FROM root_files)"""

# Which rules a .gitignore of the corpus sets, spelled out by hand.
_IGNORED = """(regexp_matches(lower(r.path), '\\.log$')
      OR regexp_matches(lower(r.path), '(^|/)docs/')
      OR (regexp_matches(lower(r.path), '^src/e[^/]*\\.ts$')
        AND NOT regexp_matches(lower(r.path), '^src/e[^/]*7\\.ts$'))
      OR regexp_matches(lower(r.path), '^src/[^a-z/][^/]*\\.ts$')
      OR regexp_matches(lower(r.path), '^lib/h[0-9][^/]*3\\.js$')
      OR regexp_matches(lower(r.path), '^lib/h[^/]*1[^/]*1[^/]*[.]j[^/]*s[^/]*$')
      OR regexp_matches(lower(r.path), '^cfg[^/]*/'))"""

_NAMES = (
    "'.env','.env.local','.env.example','.env.sample','.env.development','.env.production',"
    "'.env.staging','.gitignore','package.json','package-lock.json','pnpm-lock.yaml','yarn.lock'"
)
_DIRS = (
    "node_modules|\\.git|\\.svn|dist|build|out|\\.next|\\.nuxt|\\.turbo|\\.vercel|coverage|"
    "\\.nyc_output|storybook-static|\\.cache|tmp|temp"
)
CODE = "regexp_matches(path, '\\.(ts|tsx|js|jsx)$')"
TEST = (
    "(regexp_matches(path, '(^|/)__tests__(/|$)') OR "
    "regexp_matches(path, '\\.(test|spec)\\.[^/]*$'))"
)
APP_CODE = f"(regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT {TEST})"

MARKED = f"""
with_rules AS (
  SELECT r.*, g.project_id IS NOT NULL AND {_IGNORED} AS ignored
  FROM raw_files r LEFT JOIN (SELECT project_id FROM raw_files WHERE path = '.gitignore') g
    USING (project_id)),
marked AS (
  SELECT project_id, path, content, ignored,
    NOT ignored
    AND (regexp_extract(path, '[^/]*$') IN ({_NAMES})
      OR regexp_matches(path, '[^/]\\.(ts|tsx|js|jsx|mjs|cjs|json)$'))
    AND NOT regexp_matches(lower(path), '(^|/)({_DIRS})/') AS selected
  FROM with_rules),
files AS (SELECT project_id, path, content FROM marked WHERE selected)"""

# --- markers -----------------------------------------------------------------------------------

API = "(contains(path, '/api/') OR starts_with(path, 'api/'))"
RISKY = any_of(
    "path", ["/admin", "/users", "/payment", "/billing", "/settings", "/dashboard"]
)
ADMIN = any_of("path", ["/admin", "/superuser", "/manage", "/moderat"])
CLIENT = (
    "(contains(content, '\"use client\"') OR contains(content, '''use client''') OR "
    "(starts_with(path, 'pages/') AND NOT starts_with(path, 'pages/api/')))"
)
SERVER = (
    "(contains(content, '\"use server\"') OR contains(content, '''use server''') OR "
    "starts_with(path, 'app/api/') OR starts_with(path, 'pages/api/'))"
)
MUTATING = (
    "(regexp_matches(content, 'export (async )?function (POST|PUT|PATCH|DELETE)') OR "
    "(contains(content, 'req.method') AND "
    "regexp_matches(content, '\"(POST|PUT|PATCH|DELETE)\"|''(POST|PUT|PATCH|DELETE)''')))"
)
AUTH = any_of(
    "content",
    ["getServerSession", "await auth()", "import { auth }", "supabase.auth.getUser",
     "supabase.auth.getSession", "verifyToken", "jwt.verify", "requireAuth", "checkAuth",
     "isAuthenticated"],
)
AUTHZ = any_of(
    "content",
    ["isAdmin", "role", "hasPermission", "permissions", "ownerId", "user.id ===", "userId ===",
     "req.user.id", "session.user.id", "canAccess", "authorize"],
)
BODY = any_of("content", ["req.json()", "request.json()", "req.body"])
VALIDATED = any_of(
    "content",
    ["zod", "yup", "joi", "valibot", "superstruct", "io-ts", "class-validator", ".parse(",
     ".safeParse(", ".validate(", ".validateSync(", ".validateAsync("],
)

_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOCAL = (
    "(?i)(^|[^A-Za-z0-9_])(localhost|127\\.0\\.0\\.1|\\[?::1\\]?"
    f"|10\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}|192\\.168\\.{_OCTET}\\.{_OCTET}"
    f"|172\\.(1[6-9]|2[0-9]|3[01])\\.{_OCTET}\\.{_OCTET})($|[^A-Za-z0-9_])"
)
PUBLIC = "(?i)NEXT_PUBLIC_[A-Z_]*(SECRET|PRIVATE|PASSWORD|SERVICE_ROLE)[A-Z_]*"
VENDOR = (
    "sk-ant-[A-Za-z0-9_-]{20,}|sk-(proj-)?[A-Za-z0-9]{20,}|(sk|rk)_live_[A-Za-z0-9]{16,}"
    "|(AKIA|ASIA)[A-Z0-9]{16}|sb(p|_secret)_[A-Za-z0-9_]{20,}"
)
JWT = "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"
ASSIGN = (
    "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)"
    "[ \t]*[:=][ \t]*[\"']([A-Za-z0-9_/+=.-]{16,})[\"']"
)


def redact(col: str) -> str:
    return (
        f"CASE WHEN length({col}) = 0 THEN {col} WHEN length({col}) <= 4 THEN '***' "
        f"WHEN length({col}) <= 8 THEN left({col}, 2) || '***' || right({col}, 1) "
        f"ELSE left({col}, 4) || '...' || right({col}, 4) END"
    )


# --- lines, contexts, findings -------------------------------------------------------------------

LINES = """
cut AS (
  SELECT project_id, path, content, unnest(l) AS text, generate_subscripts(l, 1) AS line
  FROM (SELECT *, string_split(content, chr(10)) AS l FROM files)),
all_lines AS (
  SELECT project_id, path, content, text, CAST(line AS INT) AS line,
    lag(text) OVER w AS prv, lead(text) OVER w AS nxt
  FROM cut WINDOW w AS (PARTITION BY project_id, path ORDER BY line)),
muted_lines AS (
  SELECT *, contains(content, 'fleetscan-disable-file')
    OR contains(text, 'fleetscan-disable-line')
    OR coalesce(contains(prv, 'fleetscan-disable-next-line'), false) AS muted
  FROM all_lines)"""

CONTEXT = """
manifests AS (
  SELECT project_id, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j
  FROM raw_files WHERE path = 'package.json'),
pkg AS (
  SELECT project_id,
    CASE WHEN json_type(j, '$.dependencies') = 'OBJECT' THEN j -> '$.dependencies' END AS deps,
    CASE WHEN json_type(j, '$.devDependencies') = 'OBJECT' THEN j -> '$.devDependencies' END AS dev,
    CASE WHEN json_type(j, '$.scripts') = 'OBJECT' THEN j -> '$.scripts' END AS scripts,
    j ->> '$.engines.node' AS node_version
  FROM manifests),
flags AS (
  SELECT project_id,
    bool_or(path = 'tsconfig.json') AS has_typescript,
    bool_or(path IN ('.gitignore', 'gitignore')) AS has_gitignore,
    bool_or(path IN ('.env', '.env.local')) AS has_env_file,
    bool_or(path = '.env.example') AS has_env_example,
    bool_or(path = 'README.md') AS has_readme,
    bool_or(path = 'pnpm-lock.yaml') AS uses_pnpm,
    bool_or(path = 'yarn.lock') AS uses_yarn,
    bool_or(path = '.gitignore' AND list_contains(
      list_transform(string_split(content, chr(10)), lambda x: """ + trim("x") + """), '.env'))
      AS env_listed
  FROM raw_files GROUP BY project_id),
context AS (
  SELECT f.*, p.deps, p.dev, p.scripts, p.node_version,
    CASE WHEN coalesce(p.deps ->> 'next', '') <> '' THEN 'nextjs'
      WHEN coalesce(p.dev ->> 'vite', '') <> '' OR coalesce(p.deps ->> 'vite', '') <> '' THEN 'vite'
      WHEN coalesce(p.deps ->> 'express', '') <> '' THEN 'express' ELSE 'unknown' END AS framework,
    CASE WHEN has_typescript THEN 'typescript' ELSE 'javascript' END AS language,
    CASE WHEN uses_pnpm THEN 'pnpm' WHEN uses_yarn THEN 'yarn' ELSE 'npm' END AS package_manager,
    len(list_intersect(coalesce(json_keys(p.dev), []),
      ['jest', 'vitest', 'mocha', 'cypress', 'playwright'])) > 0
      OR len(list_filter(coalesce(json_keys(p.scripts), []), lambda x: contains(x, 'test'))) > 0
      AS has_tests,
    regexp_replace(p.deps ->> 'next', '[\\^~]', '', 'g') AS nextjs_version
  FROM flags f LEFT JOIN pkg p USING (project_id)),
first_manifest AS (
  SELECT project_id, path AS file, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j
  FROM files WHERE path = 'package.json' OR path LIKE '%/package.json'
  QUALIFY row_number() OVER (PARTITION BY project_id
    ORDER BY length(path) - length(replace(path, '/', '')), path) = 1),
dep_errors AS (
  SELECT project_id, CASE WHEN json_type(j) = 'NULL' THEN 'the manifest is null'
    ELSE 'the manifest''s scripts are not an object' END AS message
  FROM first_manifest WHERE json_type(j) = 'NULL'
    OR json_type(j, '$.scripts') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')),
any_uses AS (
  SELECT project_id, CAST(sum(len(regexp_extract_all(content, '\\bany\\b'))) AS BIGINT) AS n
  FROM files WHERE """ + CODE + """ GROUP BY project_id)"""

# rule_id, severity, category, blocking, confidence, prefix, detector, tail, rule order, auto fix
_RULES = """
  ('secret/hardcoded-api-key','critical','secret',true,'high','SEC',0,0,0,false),
  ('secret/hardcoded-jwt','high','secret',true,'medium','SEC',0,0,1,false),
  ('secret/hardcoded-credential','high','secret',false,'low','SEC',0,0,2,false),
  ('secret/env-not-ignored','critical','secret',true,'high','SEC',0,0,3,true),
  ('frontend_exposure/service-role-key','critical','frontend_exposure',true,'high','FE',1,0,0,false),
  ('frontend_exposure/public-secret-var','high','frontend_exposure',true,'high','FE',1,0,1,false),
  ('auth/missing-route-auth','critical','auth',true,'medium','AUTH',2,0,0,false),
  ('auth/missing-route-auth','high','auth',false,'medium','AUTH',2,0,0,false),
  ('validation/missing-body-validation','high','validation',false,'medium','VAL',3,0,0,false),
  ('authorization/missing-role-check','high','authorization',false,'medium','AUTHZ',4,0,0,false),
  ('dependency/risky-install-script','high','dependency',false,'medium','DEP',5,0,0,false),
  ('dependency/excessive-dependencies','low','dependency',false,'high','DEP',5,0,1,false),
  ('code_quality/huge-file','low','code_quality',false,'high','QUAL',6,0,-1,false),
  ('code_quality/empty-catch','medium','code_quality',false,'medium','QUAL',6,0,1,false),
  ('code_quality/console-log','low','code_quality',false,'high','QUAL',6,0,2,true),
  ('code_quality/excessive-any','medium','code_quality',false,'high','QUAL',6,1,3,false),
  ('code_quality/hardcoded-localhost','medium','code_quality',false,'high','QUAL',7,0,0,false),
  ('structure/missing-gitignore','high','structure',false,'high','STRUCT',8,0,0,false),
  ('structure/missing-readme','low','structure',false,'high','STRUCT',8,0,1,false),
  ('structure/missing-env-example','low','structure',false,'high','STRUCT',8,0,2,true),
  ('structure/missing-tests','low','structure',false,'low','STRUCT',8,0,3,false)"""

FINDINGS = f"""
rules(rule_id, severity, category, deploy_blocking, confidence, prefix, detector_ord, tail,
  rule_ord, auto_fix_available) AS (VALUES {_RULES}),
api_files AS (SELECT * FROM files WHERE {API}),
secret_lines AS (
  SELECT * FROM muted_lines WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs|json)$')
    AND NOT {TEST} AND regexp_extract(path, '[^/]*$') <> 'package-lock.json'),
line_hits AS (
  SELECT project_id, 'secret/hardcoded-api-key' AS rule_id, 'critical' AS severity, path AS file,
    line, {redact(f"regexp_extract(text, {lit(VENDOR)})")} AS evidence, muted
  FROM secret_lines WHERE regexp_matches(text, {lit(VENDOR)})
  UNION ALL SELECT project_id, 'secret/hardcoded-jwt', 'high', path, line,
    {redact(f"regexp_extract(text, {lit(JWT)})")}, muted
  FROM secret_lines WHERE regexp_matches(text, {lit(JWT)})
  UNION ALL SELECT project_id, 'secret/hardcoded-credential', 'high', path, line,
    {redact(f"regexp_extract(text, {lit(ASSIGN)}, 1)")}, muted
  FROM secret_lines WHERE regexp_matches(text, {lit(ASSIGN)})
  UNION ALL SELECT project_id, 'frontend_exposure/service-role-key', 'critical', path, line,
    {trim("text")}, muted FROM muted_lines WHERE {CODE} AND {CLIENT}
    AND (contains(text, 'SERVICE_ROLE_KEY') OR contains(text, 'service_role'))
  UNION ALL SELECT project_id, 'frontend_exposure/public-secret-var', 'high', path, line,
    regexp_extract(text, {lit(PUBLIC)}), muted FROM muted_lines WHERE {CODE} AND {CLIENT}
    AND regexp_matches(text, {lit(PUBLIC)})
  UNION ALL SELECT project_id, 'code_quality/empty-catch', 'medium', path, line, {trim("text")},
    muted FROM muted_lines WHERE {CODE} AND contains(text, 'catch')
    AND (contains(text, '{{}}') OR coalesce({trim("nxt")} = '}}', false))
  UNION ALL SELECT project_id, 'code_quality/console-log', 'low', path, line, {trim("text")}, muted
  FROM muted_lines WHERE {CODE} AND contains(text, 'console.log(')
  UNION ALL SELECT project_id, 'code_quality/hardcoded-localhost', 'medium', path, line,
    {trim("text")}, muted FROM muted_lines WHERE {APP_CODE} AND regexp_matches(text, {lit(LOCAL)})),
file_hits AS (
  SELECT project_id, 'auth/missing-route-auth' AS rule_id,
    CASE WHEN {RISKY} THEN 'critical' ELSE 'high' END AS severity, path AS file, NULL AS evidence
  FROM api_files WHERE ({RISKY} OR {MUTATING}) AND NOT {AUTH}
  UNION ALL SELECT project_id, 'validation/missing-body-validation', 'high', path, NULL
  FROM api_files WHERE {BODY} AND NOT {VALIDATED}
  UNION ALL SELECT project_id, 'authorization/missing-role-check', 'high', path, NULL
  FROM api_files WHERE {ADMIN} AND {AUTH} AND NOT {AUTHZ}
  UNION ALL SELECT project_id, 'code_quality/huge-file', 'low', path,
    len(string_split(content, chr(10))) || ' lines'
  FROM files WHERE {CODE} AND len(string_split(content, chr(10))) > 500),
project_hits AS (
  SELECT project_id, 'secret/env-not-ignored' AS rule_id, 'critical' AS severity,
    '.gitignore' AS file, NULL AS evidence, 0 AS ordinal
  FROM context WHERE has_env_file AND NOT env_listed
  UNION ALL
  SELECT m.project_id, 'dependency/risky-install-script', 'high', m.file,
    '"' || k.k || '": "' || (m.j -> '$.scripts' ->> k.k) || '"', k.o
  FROM first_manifest m, (VALUES ('preinstall', 0), ('postinstall', 1), ('install', 2)) k(k, o)
  WHERE json_type(m.j, '$.scripts') = 'OBJECT'
    AND list_contains(json_keys(m.j, '$.scripts'), k.k)
  UNION ALL
  SELECT project_id, 'dependency/excessive-dependencies', 'low', file,
    len(json_keys(j, '$.dependencies')) || ' direct dependencies', 0
  FROM first_manifest m WHERE json_type(j, '$.dependencies') = 'OBJECT'
    AND len(json_keys(j, '$.dependencies')) > 80
    AND project_id NOT IN (SELECT project_id FROM dep_errors)
  UNION ALL SELECT project_id, 'code_quality/excessive-any', 'medium', NULL,
    n || ' uses of any in the project', 0 FROM any_uses WHERE n > 20
  UNION ALL SELECT project_id, 'structure/missing-gitignore', 'high', NULL, NULL, 0
  FROM context WHERE NOT has_gitignore
  UNION ALL SELECT project_id, 'structure/missing-readme', 'low', NULL, NULL, 0
  FROM context WHERE NOT has_readme
  UNION ALL SELECT project_id, 'structure/missing-env-example', 'low', NULL, NULL, 0
  FROM context WHERE has_env_file AND NOT has_env_example
  UNION ALL SELECT project_id, 'structure/missing-tests', 'low', NULL, NULL, 0
  FROM context WHERE NOT has_tests),
hits AS (
  SELECT project_id, rule_id, severity, file, line, evidence, 0 AS ordinal
  FROM line_hits WHERE NOT muted
  UNION ALL SELECT project_id, rule_id, severity, file, NULL, evidence, 0 FROM file_hits
  UNION ALL SELECT project_id, rule_id, severity, file, NULL, evidence, ordinal FROM project_hits),
findings AS (
  SELECT h.project_id, r.prefix || '-' || left(sha256(concat_ws('|', h.project_id, h.rule_id,
      coalesce(h.file, ''), coalesce(CAST(h.line AS VARCHAR), ''), CAST(h.ordinal AS VARCHAR))), 12)
      AS id,
    h.rule_id, h.severity, r.category, r.deploy_blocking, r.confidence, h.file, h.line, h.evidence,
    r.auto_fix_available, CASE h.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1
      WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank,
    r.detector_ord, r.tail, r.rule_ord, h.ordinal
  FROM hits h JOIN rules r ON h.rule_id = r.rule_id AND h.severity = r.severity)"""

COLS = (
    "project_id, rule_id, severity, category, deploy_blocking, confidence, file, line, evidence"
)
ORDER = (
    "severity_rank, detector_ord, tail, coalesce(file, ''), coalesce(line, 0), rule_ord, ordinal"
)
STEPS = f"""
steps AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {ORDER}) AS INT) AS "order",
    CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 ELSE 5 END AS minutes
  FROM findings)"""
SCORES = """
weights(severity, w) AS (VALUES ('critical', -20), ('high', -10), ('medium', -5), ('low', -2)),
factors(category, m) AS (VALUES ('secret', 15), ('frontend_exposure', 13), ('auth', 12),
  ('authorization', 11), ('validation', 10), ('dependency', 8), ('code_quality', 5),
  ('structure', 3)),
sums AS (
  SELECT project_id, sum(w * m) AS tenths, bool_or(severity = 'critical') AS crit, count(*) AS total
  FROM findings JOIN weights USING (severity) JOIN factors USING (category) GROUP BY project_id),
points AS (
  SELECT project_id, CAST(greatest(0, floor((1005 + coalesce(tenths, 0)) / 10)) AS INT) AS score,
    coalesce(crit, false) AS crit, CAST(coalesce(total, 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT project_id FROM raw_files) LEFT JOIN sums USING (project_id)),
scores AS (
  SELECT project_id, score, total, CASE WHEN crit THEN 'blocker' WHEN score < 40 THEN 'danger'
    WHEN score < 70 THEN 'warning' ELSE 'safe' END AS deploy_status
  FROM points)"""


def sql(final: str, *parts: str) -> str:
    return "WITH " + ",".join((CORPUS, RAW, *parts)) + "\n" + final


def found(final: str, *parts: str) -> str:
    """On the findings of a whole scan."""
    return sql(final, MARKED, LINES, CONTEXT, FINDINGS, *parts)


def rule(*rule_ids: str) -> str:
    names = ", ".join(lit(r) for r in rule_ids)
    return found(f"SELECT {COLS} FROM findings WHERE rule_id IN ({names})")


# --- variants of the corpus ----------------------------------------------------------------------

_LATER = """
labelled AS (SELECT DISTINCT doc_id FROM labels),
raw_files AS (
  SELECT project_id, path, CASE WHEN l.doc_id IS NOT NULL THEN text ELSE content END AS content
  FROM doc_files d LEFT JOIN labelled l ON d.doc_id = l.doc_id
  UNION ALL SELECT project_id, path, content FROM root_files)"""


def later(final: str, *parts: str) -> str:
    """On the corpus some time later."""
    return "WITH " + ",".join((CORPUS, _LATER, *parts)) + "\n" + final


_SAVES = """
saves AS (
  SELECT CASE WHEN user_id % 20 < 6 THEN 'mono'
      ELSE 'src' || (user_id % 20) || '-' || (user_id // 20) END AS project_id,
    CASE WHEN event_type = 'view' THEN 'live/notes.md' ELSE 'live/' || event_type || '.ts' END AS path,
    CASE event_id % 3 WHEN 0 THEN 'console.log(' || event_id || ')' || chr(10)
      WHEN 1 THEN 'export const version = ' || event_id
      ELSE 'try { load() } catch (e) {}' || chr(10) || 'fetch("http://localhost:' || event_id || '")'
    END AS content, ts
  FROM events),
code_saves AS (SELECT * FROM saves WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$'))"""


def _sessions(gap: str) -> str:
    return f"""
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY project_id, path ORDER BY ts) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY project_id, path ORDER BY ts) AS before
    FROM code_saves)),
sessions AS (
  SELECT project_id, path, max_by(content, ts) AS content, max(ts) AS saved_at,
    count(*) AS saves, max(ts) + INTERVAL {gap} AS closes
  FROM numbered GROUP BY project_id, path, session)"""


_LIVE = """
moved AS (
  SELECT project_id, CASE second(ts) % 7 WHEN 1 THEN 'docs/' || path WHEN 2 THEN 'package.json'
      WHEN 3 THEN 'README.md' ELSE path END AS path,
    CASE WHEN second(ts) % 7 = 2 THEN '{"dependencies": {"express": "' || len(content)
      || '"}, "scripts": {"test": "x"}}' ELSE content END AS content, ts
  FROM saves),
live AS (
  SELECT project_id, path, max_by(content, (ts, content)) AS content FROM moved
  WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$') OR path IN ('package.json', 'README.md')
  GROUP BY project_id, path),
raw_files AS (
  SELECT project_id, path, content FROM (
    SELECT project_id, path, content FROM doc_files
    UNION ALL SELECT project_id, path, content FROM root_files) ANTI JOIN live USING (project_id, path)
  UNION ALL SELECT project_id, path, content FROM live)"""

# --- fixes -----------------------------------------------------------------------------------------

_FIXED = f"""
log_lines AS (
  SELECT DISTINCT project_id, file, line FROM findings
  WHERE rule_id = 'code_quality/console-log'),
log_files AS (
  SELECT a.project_id, a.path, string_agg(CASE WHEN g.line IS NOT NULL
      THEN replace(a.text, 'console.log', '/* console.log */') ELSE a.text END, chr(10)
      ORDER BY a.line) AS new_content
  FROM all_lines a LEFT JOIN log_lines g
    ON a.project_id = g.project_id AND a.path = g.file AND a.line = g.line
  WHERE (a.project_id, a.path) IN (SELECT (project_id, file) FROM log_lines)
  GROUP BY a.project_id, a.path),
env_files AS (
  SELECT r.project_id, '.env.example' AS path, {{example}} AS new_content
  FROM raw_files r JOIN (SELECT project_id FROM findings
    WHERE rule_id = 'structure/missing-env-example') USING (project_id) WHERE r.path = '.env'),
ignore_files AS (
  SELECT f.project_id, '.gitignore' AS path, CASE
    WHEN g.content IS NULL THEN 'node_modules' || chr(10) || '.env' || chr(10) || '.env.*' || chr(10)
    ELSE g.content || CASE WHEN g.content = '' OR g.content LIKE ('%' || chr(10)) THEN ''
      ELSE chr(10) END || '.env' || chr(10) || '.env.*' || chr(10) END AS new_content,
    g.content IS NULL AS created
  FROM (SELECT project_id FROM findings WHERE rule_id = 'secret/env-not-ignored') f
  LEFT JOIN (SELECT project_id, content FROM raw_files WHERE path = '.gitignore') g USING (project_id)),
fixed AS (
  SELECT project_id, path, new_content FROM log_files
  UNION ALL SELECT project_id, path, new_content FROM env_files
  UNION ALL SELECT project_id, path, new_content FROM ignore_files)"""


def example(col: str, strict: bool = False) -> str:
    """Environment text without values, as a list transform."""
    key = "regexp_extract(x, '^([^=]+)=', 1)"
    rest = f"substr(x, length({key}) + 2)"
    extra = f" AND NOT regexp_matches({rest}, '[\\r\\x{{2028}}\\x{{2029}}]')" if strict else ""
    one = (
        f"CASE WHEN {trim('x')} = '' OR starts_with({trim('x')}, '#') THEN x "
        f"WHEN {key} <> ''{extra} THEN {key} || '=' ELSE x END"
    )
    return f"array_to_string(list_transform(string_split({col}, chr(10)), lambda x: {one}), chr(10))"


FIXED = _FIXED.replace("{example}", example("r.content"))

_FIXABLE = (
    "('secret/env-not-ignored', 'structure/missing-env-example', 'code_quality/console-log')"
)

# --- the queries -------------------------------------------------------------------------------------

_TITLES = """
titles AS (
  SELECT *, CASE rule_id
    WHEN 'secret/hardcoded-api-key' THEN 'A vendor API key written into the source'
    WHEN 'secret/hardcoded-jwt' THEN 'A signed token written into the source'
    WHEN 'secret/hardcoded-credential' THEN 'A credential written into the source'
    WHEN 'secret/env-not-ignored' THEN 'Environment file is not ignored by git'
    WHEN 'frontend_exposure/service-role-key' THEN 'Administrative database key in browser code'
    WHEN 'frontend_exposure/public-secret-var' THEN 'Secret under a public variable name'
    WHEN 'auth/missing-route-auth' THEN 'API route without a sign-in check'
    WHEN 'validation/missing-body-validation' THEN 'Request body used unchecked'
    WHEN 'authorization/missing-role-check' THEN 'Admin route without a role check'
    WHEN 'dependency/risky-install-script' THEN 'Script runs on install: '
      || regexp_extract(evidence, '"([a-z]+)"', 1)
    WHEN 'dependency/excessive-dependencies' THEN evidence
    WHEN 'code_quality/huge-file' THEN 'Very long file'
    WHEN 'code_quality/empty-catch' THEN 'Errors swallowed'
    WHEN 'code_quality/console-log' THEN 'Debug output left in'
    WHEN 'code_quality/excessive-any' THEN 'Type checks switched off in many places'
    WHEN 'code_quality/hardcoded-localhost' THEN 'Local or private address in the code'
    WHEN 'structure/missing-gitignore' THEN 'No .gitignore'
    WHEN 'structure/missing-readme' THEN 'No README.md'
    WHEN 'structure/missing-env-example' THEN 'No example environment file'
    WHEN 'structure/missing-tests' THEN 'No tests' END AS title
  FROM steps)"""

_EXCLUDED = """(regexp_matches(lower(path), '(^|/)components/')
    OR regexp_matches(lower(path), '^src/s[^/]*1\\.ts$')
    OR (regexp_matches(lower(path), '^pages/.+')
      AND NOT regexp_matches(lower(path), '^pages/p1[^/]*\\.tsx$')))"""
assert EXCLUDES == ("c*o*m*p*o*n*e*n*t*s*/", "/src/s*1.ts", "pages/**", "!pages/p1*.tsx")


def _crc32(col: str) -> str:
    """The CRC-32 of an ASCII text: each byte, then eight steps."""
    bits = f"flatten(list_transform(string_split({col}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END"
    return f"xor(list_reduce([4294967295] || {bits}, lambda r, x: {step}), 4294967295)"


def _json_map(col: str) -> str:
    pairs = f"list_transform(coalesce(json_keys({col}), []), lambda k: k || '=' || ({col} ->> k))"
    return f"array_to_string(list_sort({pairs}), ',')"


def _category_counts() -> str:
    names = ["secret", "auth", "authorization", "frontend_exposure", "validation", "dependency",
             "code_quality", "structure"]
    return ", ".join(f"CAST(count(*) FILTER (category = '{c}') AS BIGINT) AS n_{c}" for c in names)


_SEV = ", ".join(
    f"CAST(count(*) FILTER (severity = '{s}') AS BIGINT) AS {s}"
    for s in ("critical", "high", "medium", "low")
)
_EVERY = "(SELECT DISTINCT project_id FROM raw_files)"

ORACLES = {
    "selected_files": sql("SELECT project_id, path FROM files", MARKED),
    "gitignore_filter": sql("SELECT project_id, path FROM marked WHERE NOT ignored", MARKED),
    "extra_excludes": sql(
        f"SELECT project_id, path FROM files WHERE NOT {_EXCLUDED}", MARKED
    ),
    "scan_capped": sql(
        f"""SELECT project_id, 'reader' AS detector_id,
        (count(*) - {CAP}) || ' files beyond the cap were left out' AS message
        FROM files GROUP BY project_id HAVING count(*) > {CAP}""",
        MARKED,
    ),
    "capped_files": sql(
        f"SELECT project_id, path FROM files QUALIFY row_number() OVER "
        f"(PARTITION BY project_id ORDER BY path) <= {CAP}",
        MARKED,
    ),
    "target_files": sql(
        "SELECT project_id, path FROM doc_files WHERE doc_id IN (SELECT doc_id FROM labels)"
    ),
    "file_classes": sql(
        f"""SELECT project_id, path, {CODE} AS is_code, {APP_CODE} AS is_app_code,
        {API} AS is_api_route, {RISKY} AS is_risky_route, {ADMIN} AS is_admin_route,
        {CLIENT} AS is_client, {SERVER} AS is_server,
        CASE WHEN {CLIENT} AND {SERVER} THEN 'both' WHEN {CLIENT} THEN 'client'
          WHEN {SERVER} THEN 'server' ELSE 'neutral' END AS file_side,
        {MUTATING} AS has_mutating_handler, {AUTH} AS has_auth, {AUTHZ} AS has_authorization,
        {BODY} AS reads_body, {VALIDATED} AS has_validation FROM raw_files"""
    ),
    "project_context": sql(
        f"""SELECT project_id, framework, language, has_typescript, package_manager,
        {_json_map("deps")} AS dependencies, {_json_map("dev")} AS dev_dependencies,
        {_json_map("scripts")} AS scripts, has_gitignore, has_env_file, has_env_example, has_readme,
        has_tests, nextjs_version, node_version FROM context""",
        MARKED, CONTEXT,
    ),
    "d_secrets": rule(
        "secret/hardcoded-api-key", "secret/hardcoded-jwt", "secret/hardcoded-credential"
    ),
    "d_env_not_ignored": rule("secret/env-not-ignored"),
    "d_service_role": rule("frontend_exposure/service-role-key"),
    "d_public_secret": rule("frontend_exposure/public-secret-var"),
    "d_missing_auth": rule("auth/missing-route-auth"),
    "d_missing_role": rule("authorization/missing-role-check"),
    "d_missing_validation": rule("validation/missing-body-validation"),
    "d_install_script": rule("dependency/risky-install-script"),
    "d_excess_deps": rule("dependency/excessive-dependencies"),
    "d_huge_file": rule("code_quality/huge-file"),
    "d_empty_catch": rule("code_quality/empty-catch"),
    "d_console_log": rule("code_quality/console-log"),
    "d_excess_any": rule("code_quality/excessive-any"),
    "d_localhost": rule("code_quality/hardcoded-localhost"),
    "d_structure": rule(
        "structure/missing-gitignore", "structure/missing-readme",
        "structure/missing-env-example", "structure/missing-tests",
    ),
    "detector_errors": sql(
        """SELECT project_id, 'dependency-detector' AS detector_id,
        'Dependencies and install scripts' AS detector_name, message FROM dep_errors""",
        MARKED, CONTEXT,
    ),
    "all_findings": found(
        f"SELECT id, {COLS}, auto_fix_available, severity_rank, detector_ord, tail FROM findings"
    ),
    "inline_ignores": found(f"SELECT {COLS} FROM findings"),
    "min_severity": found(f"SELECT {COLS} FROM findings WHERE severity <> 'low'"),
    "enabled_categories": found(
        f"SELECT {COLS} FROM findings WHERE category IN ('auth', 'dependency')"
    ),
    "enabled_by_project": found(
        f"""SELECT {COLS} FROM findings JOIN (SELECT project_id, language FROM context)
          USING (project_id)
        WHERE language <> 'typescript' OR category IN ('auth', 'structure')"""
    ),
    "pruned_scan": found(
        f"""SELECT {COLS} FROM findings
        WHERE category IN ('code_quality', 'structure') AND severity <> 'low'"""
    ),
    "find_first": found(
        f"""SELECT id, {COLS} FROM findings WHERE rule_id = 'code_quality/console-log'
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {ORDER}) = 1"""
    ),
    "score": found(
        """SELECT project_id, score, deploy_status,
        CASE WHEN deploy_status IN ('blocker', 'danger') THEN 1 ELSE 0 END AS exit_code, total
        FROM scores""",
        SCORES,
    ),
    "score_from_findings": found(
        """SELECT project_id, score, deploy_status,
        CASE WHEN deploy_status IN ('blocker', 'danger') THEN 1 ELSE 0 END AS exit_code,
        CASE deploy_status WHEN 'warning' THEN 'Fix before release'
          WHEN 'safe' THEN 'Ready to deploy' ELSE 'Do not deploy' END AS status_label,
        CASE deploy_status
          WHEN 'blocker' THEN 'At least one critical issue is open; resolve it first.'
          WHEN 'danger' THEN 'Too many open issues for a release.'
          WHEN 'warning' THEN 'Some issues should be dealt with before going live.'
          ELSE 'Only minor improvements are left.' END AS status_message FROM scores""",
        SCORES,
    ),
    "score_float_fold": found(
        f"""SELECT project_id, CAST(greatest(0, floor(coalesce(total, 100.0::DOUBLE) + 0.5)) AS INT)
          AS score
        FROM {_EVERY} LEFT JOIN (
          SELECT project_id, list_reduce(list_prepend(100.0::DOUBLE, list(w ORDER BY o)),
            lambda a, b: a + b) AS total
          FROM (SELECT f.project_id, w.w::DOUBLE * (m.m / 10.0)::DOUBLE AS w,
              row_number() OVER (PARTITION BY f.project_id ORDER BY {ORDER}) AS o
            FROM findings f JOIN weights w USING (severity) JOIN factors m USING (category))
          GROUP BY project_id) USING (project_id)""",
        SCORES,
    ),
    "summary": found(
        f"""SELECT s.project_id, coalesce(total, 0) AS total,
        {", ".join(f"coalesce({c}, 0) AS {c}" for c in (
            "critical", "high", "medium", "low", "n_secret", "n_auth", "n_authorization",
            "n_frontend_exposure", "n_validation", "n_dependency", "n_code_quality",
            "n_structure"))}, files_scanned, lines_scanned
        FROM (SELECT project_id, count(*) AS files_scanned,
            CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines_scanned
          FROM files GROUP BY project_id) s
        LEFT JOIN (SELECT project_id, count(*) AS total, {_SEV}, {_category_counts()}
          FROM findings GROUP BY project_id) f USING (project_id)"""
    ),
    "severity_share": found(
        f"""SELECT project_id, {", ".join(
            f"CASE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE {s}::DOUBLE / total * 100 END"
            f" AS {s}_pct" for s in ("critical", "high", "medium", "low"))}
        FROM {_EVERY} LEFT JOIN (SELECT project_id, count(*) AS total, {_SEV}
          FROM findings GROUP BY project_id) USING (project_id)"""
    ),
    "decision": found(
        f"""SELECT project_id, CASE
          WHEN critical > 0 AND high > 0 THEN critical || ' critical and ' || high || ' high findings.'
          WHEN critical > 0 THEN critical || ' critical findings.'
          WHEN high > 0 THEN high || ' high findings.'
          WHEN total > 0 THEN total || ' findings.'
          ELSE 'Nothing stands in the way of a release.' END AS reason,
        coalesce('First: ' || t.title, 'Nothing to do.') AS next_action
        FROM {_EVERY} LEFT JOIN (SELECT project_id, count(*) AS total, {_SEV}
          FROM findings GROUP BY project_id) USING (project_id)
        LEFT JOIN (SELECT project_id, title FROM titles WHERE "order" = 1) t USING (project_id)""",
        STEPS, _TITLES,
    ),
    "by_severity": found(
        """SELECT project_id, severity, count(*) AS n, severity_rank FROM findings
        GROUP BY project_id, severity, severity_rank"""
    ),
    "worst_by_file": found(
        """SELECT project_id, file, min_by(severity, severity_rank) AS worst, count(*) AS n
        FROM findings WHERE file IS NOT NULL GROUP BY project_id, file"""
    ),
    "fleet_cube": found(
        """SELECT deploy_status, framework, count(*) AS projects,
        CAST(sum(score) AS BIGINT) AS score_sum, CAST(sum(total) AS BIGINT) AS findings,
        CAST(grouping(deploy_status, framework) AS INT) AS level
        FROM scores JOIN context USING (project_id) GROUP BY CUBE (deploy_status, framework)""",
        SCORES,
    ),
    "repair_steps": found(
        f"""SELECT project_id, "order", id AS finding_id, title, severity, category, file, line,
        auto_fix_available, minutes AS estimated_minutes,
        CAST(sum(minutes) OVER (PARTITION BY project_id ORDER BY "order") AS BIGINT)
          AS cumulative_minutes FROM titles""",
        STEPS, _TITLES,
    ),
    "repair_plan": found(
        f"""SELECT project_id, coalesce(n, 0) AS steps, coalesce(m, 0) AS estimated_minutes,
        coalesce(n, 0) || ' findings to work through, about ' || coalesce(m, 0)
          || ' minutes in all.' AS summary
        FROM {_EVERY} LEFT JOIN (SELECT project_id, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS m
          FROM steps GROUP BY project_id) USING (project_id)""",
        STEPS,
    ),
    "top_steps": found(
        """SELECT project_id, "order", id, rule_id, severity, file, line FROM steps
        WHERE "order" <= 3""",
        STEPS,
    ),
    "step_findings": found(
        f"""SELECT project_id, "order", id AS finding_id, rule_id,
        left({trim("evidence")}, 100) AS shown_evidence FROM steps""",
        STEPS,
    ),
    "by_file": found(
        """SELECT project_id, file, count(*) AS n, string_agg(line || ':' || rule_id || ':' ||
          CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END, ','
          ORDER BY line, rule_ord, rule_id, id) AS marks
        FROM findings WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY project_id, file"""
    ),
    "position_lookup": found(
        f"""SELECT p.project_id, p.path, p.pos, f.id, f.rule_id, f.severity, f.title
        FROM (SELECT project_id, path, CAST((doc_id // 320) % 6 AS INT) AS pos FROM doc_files) p
        JOIN titles f ON f.project_id = p.project_id AND f.file = p.path
          AND p.pos BETWEEN greatest(0, coalesce(f.line, 1) - 1)
            AND greatest(0, coalesce(f.line, 1) - 1)
        QUALIFY row_number() OVER (PARTITION BY p.project_id, p.path, p.pos ORDER BY "order") = 1""",
        STEPS, _TITLES,
    ),
    "within_document": found(
        """SELECT f.project_id, f.rule_id, f.file, f.line FROM findings f
        JOIN doc_files d ON f.project_id = d.project_id AND f.file = d.path
        WHERE f.line BETWEEN 1 AND len(string_split(d.text, chr(10)))"""
    ),
    "fixable": found(
        f"""SELECT project_id, id, rule_id, rule_id IN {_FIXABLE} AS has_fixer,
        auto_fix_available AND rule_id IN {_FIXABLE} AS can_fix FROM findings"""
    ),
    "fix_console_log": found(
        "SELECT project_id, path, sha256(new_content) AS digest FROM log_files", FIXED
    ),
    "fix_env_example": found("SELECT * FROM env_files", FIXED),
    "example_texts": sql(
        f"""SELECT project_id, path, sha256({example("content")}) AS digest,
        sha256({example("content", strict=True)}) AS keep_cr_digest
        FROM raw_files WHERE path = '.env' OR path LIKE '%/.env'"""
    ),
    "fix_gitignore": found("SELECT project_id, path, new_content FROM ignore_files", FIXED),
    "fix_preview": found(
        f"""SELECT f.project_id, f.id AS finding_id, f.file AS files_to_modify,
          '' AS files_to_create,
          '- ' || a.text || chr(10) || '+ ' || replace(a.text, 'console.log', '/* console.log */')
            AS diff
        FROM findings f JOIN all_lines a ON f.project_id = a.project_id AND f.file = a.path
          AND f.line = a.line WHERE f.rule_id = 'code_quality/console-log'
        UNION ALL
        SELECT f.project_id, f.id, '', CASE WHEN e.path IS NULL THEN '' ELSE e.path END,
          '+ ' || replace(e.new_content, chr(10), chr(10) || '+ ')
        FROM findings f LEFT JOIN env_files e USING (project_id)
        WHERE f.rule_id = 'structure/missing-env-example'
        UNION ALL
        SELECT f.project_id, f.id, CASE WHEN created THEN '' ELSE '.gitignore' END,
          CASE WHEN created THEN '.gitignore' ELSE '' END,
          CASE WHEN created THEN 'New .gitignore:' || chr(10) || 'node_modules' || chr(10) || '.env'
              || chr(10) || '.env.*' || chr(10)
            ELSE '+ .env' || chr(10) || '+ .env.*' || chr(10) END
        FROM findings f JOIN ignore_files i USING (project_id)
        WHERE f.rule_id = 'secret/env-not-ignored'""",
        FIXED,
    ),
    "fix_results": found(
        """SELECT project_id, id AS finding_id, true AS success, file AS files_modified,
          '' AS files_created
        FROM findings WHERE rule_id = 'code_quality/console-log'
        UNION ALL
        SELECT f.project_id, f.id, e.path IS NOT NULL, '', coalesce(e.path, '')
        FROM findings f LEFT JOIN env_files e USING (project_id)
        WHERE f.rule_id = 'structure/missing-env-example'
        UNION ALL
        SELECT f.project_id, f.id, true, CASE WHEN created THEN '' ELSE '.gitignore' END,
          CASE WHEN created THEN '.gitignore' ELSE '' END
        FROM findings f JOIN ignore_files i USING (project_id)
        WHERE f.rule_id = 'secret/env-not-ignored'""",
        FIXED,
    ),
    "apply_fix": found(
        """SELECT project_id, path, sha256(content) AS digest FROM (
          SELECT r.project_id, r.path, coalesce(f.new_content, r.content) AS content
          FROM raw_files r LEFT JOIN fixed f USING (project_id, path)
          UNION ALL SELECT f.project_id, f.path, f.new_content FROM fixed f
          ANTI JOIN raw_files r USING (project_id, path))""",
        FIXED,
    ),
    # Every fix removes its finding, and none of them brings another of these rules back.
    "fix_verify": found(
        f"""SELECT DISTINCT project_id, rule_id, file, line, false AS still_exists FROM findings
        WHERE rule_id IN {_FIXABLE}"""
    ),
    "scan_diff": (
        "WITH before AS ("
        + found("SELECT project_id, rule_id, file, line FROM findings")
        + "), after AS ("
        + later("SELECT project_id, rule_id, file, line FROM findings", MARKED, LINES, CONTEXT, FINDINGS)
        + """) SELECT project_id, rule_id, file, line, CAST(sum(b) AS BIGINT) AS n_before,
        CAST(sum(a) AS BIGINT) AS n_after, CASE WHEN sum(b) = 0 THEN 'new'
          WHEN sum(a) = 0 THEN 'resolved' ELSE 'persisting' END AS status
        FROM (SELECT *, 1 AS b, 0 AS a FROM before UNION ALL SELECT *, 0, 1 FROM after)
        GROUP BY project_id, rule_id, file, line"""
    ),
    "merge_findings": later(f"SELECT {COLS} FROM findings", MARKED, LINES, CONTEXT, FINDINGS),
    "rescan_scores": later(
        """SELECT project_id, score, deploy_status, total, coalesce(files_scanned, 0) AS files_scanned,
          coalesce(lines_scanned, 0) AS lines_scanned
        FROM scores LEFT JOIN (SELECT project_id, count(*) AS files_scanned,
            CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines_scanned
          FROM files GROUP BY project_id) USING (project_id)""",
        MARKED, LINES, CONTEXT, FINDINGS, SCORES,
    ),
    "scan_configs": found(
        """SELECT f.project_id, rule_id, severity, file, line, NULL AS message
        FROM findings f JOIN projects p USING (project_id)
        WHERE s % 12 <> 4 AND NOT (s % 6 = 3 AND s % 12 = 3)
          AND (s % 6 <> 0 OR category IN ('auth', 'code_quality'))
          AND (s % 6 <> 1 OR severity IN ('critical', 'high'))
          AND (s % 6 <> 2 OR (severity <> 'low' AND coalesce(file NOT LIKE 'components/%', true)))
        UNION ALL SELECT project_id, NULL, NULL, NULL, NULL, 'Invalid configuration: not known: style'
        FROM projects WHERE s % 12 = 4
        UNION ALL SELECT project_id, NULL, NULL, NULL, NULL,
          'Invalid configuration: max_files must be positive' FROM projects WHERE s % 12 = 3"""
    ),
    "custom_detectors": found(
        """SELECT project_id, rule_id, count(*) AS n FROM (
          SELECT project_id, rule_id FROM findings
          UNION ALL SELECT project_id, 'own/long-line' FROM files WHERE len(list_filter(
            string_split(content, chr(10)), lambda x: len(x) > 2000)) > 0
          UNION ALL SELECT project_id, 'throwing' FROM projects)
        GROUP BY project_id, rule_id"""
    ),
    "span_lookup": sql(
        """SELECT project_id, path, pos, id, rule_id FROM (
          SELECT DISTINCT project_id, path, doc_id, unnest([doc_id % 11, doc_id * 7919 % 6000,
            doc_id * 104729 % 1000003]) AS pos FROM doc_files) p
        JOIN (SELECT doc_id, 'S0-' || path AS id, 'own/span-0' AS rule_id, doc_id % 7 + 1 AS a,
            doc_id * 1013 % 1000000 AS n, doc_id % 2 AS rank FROM doc_files
          UNION ALL SELECT doc_id, 'S1-' || path, 'own/span-1', doc_id % 5 + 300, doc_id * 31 % 5000,
            (doc_id + 1) % 2 FROM doc_files) f USING (doc_id)
        WHERE pos BETWEEN a - 1 AND a + n - 1
        QUALIFY row_number() OVER (PARTITION BY project_id, path, pos ORDER BY rank) = 1"""
    ),
    "tables_round_trip": found(
        """SELECT project_id, scan_date, name, count(*) AS n, count(DISTINCT v) AS different FROM (
          SELECT project_id, 'findings' AS name, id AS v FROM findings
          UNION ALL SELECT project_id, 'steps', id FROM steps
          UNION ALL SELECT project_id, 'projects', CAST(score AS VARCHAR) FROM scores
          UNION ALL SELECT project_id, 'errors', message FROM dep_errors),
          (VALUES ('2024-01-01'), ('2024-01-02')) dates(scan_date)
        GROUP BY project_id, scan_date, name""",
        STEPS, SCORES,
    ),
    # excluded directories are not listed, by their exact names; two bad bytes become two marks
    "tree_round_trip": sql(
        f"""SELECT project_id, path, CAST(length(t) AS INT) AS chars, sha256(t) AS digest FROM (
          SELECT project_id, path, CASE WHEN {_crc32("path")} % 7 = 0 THEN chr(65533) || chr(65533) ELSE '' END
            || any_value(content) AS t
          FROM raw_files WHERE NOT regexp_matches(path, '(^|/)({_DIRS})/') GROUP BY project_id, path)"""
    ),
    "debounce_saves": "WITH " + ",".join((_SAVES, _sessions("6 HOUR")))
    + " SELECT project_id, path, content, saves FROM sessions",
    "debounce_default": "WITH " + ",".join((_SAVES, _sessions("1500 MILLISECOND")))
    + " SELECT project_id, path, content, saves FROM sessions",
    "stream_debounce": "WITH " + ",".join((_SAVES, _sessions("6 HOUR")))
    + " SELECT project_id, path, content, saves FROM sessions",
    "stream_scores": "WITH "
    + ",".join(
        (CORPUS, _SAVES, _LIVE, MARKED, LINES, CONTEXT, FINDINGS, SCORES)
    )
    + """ SELECT project_id, score, deploy_status, total, files_scanned,
        CAST(coalesce(n_code_quality, 0) AS BIGINT) AS n_code_quality, framework, has_readme, has_tests
      FROM scores JOIN context USING (project_id)
      JOIN (SELECT project_id, count(*) AS files_scanned FROM files GROUP BY project_id)
        USING (project_id)
      LEFT JOIN (SELECT project_id, count(*) AS n_code_quality FROM findings
        WHERE category = 'code_quality' GROUP BY project_id) USING (project_id)""",
    "redact": f"""SELECT masked, count(*) AS n FROM (
        SELECT {redact("w")} AS masked FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents))
        GROUP BY masked""",
    "trimmed_lines": sql(
        f"""SELECT left({trim("line")}, 100) AS shown, count(*) AS n,
        CAST(sum(length({trim("line")})) AS BIGINT) AS chars
        FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM raw_files) GROUP BY shown"""
    ),
    "line_and_word_counts": sql(
        """SELECT project_id, path, CAST(len(string_split(content, chr(10))) AS INT) AS n_lines,
        CAST(len(regexp_extract_all(content, '\\bany\\b')) AS INT) AS any_count,
        CAST(len(regexp_extract_all(content, '\\bde\\b')) AS INT) AS de_count FROM raw_files"""
    ),
    "result_json": found(
        """SELECT project_id, 0 AS part, score, NULL AS findings, NULL AS first_id FROM scores
        UNION ALL
        SELECT project_id, CAST(("order" - 1) // 100 + 1 AS INT), NULL,
          CAST(count(*) AS INT), min_by(id, "order") FROM steps
        GROUP BY project_id, ("order" - 1) // 100""",
        STEPS, SCORES,
    ),
}
