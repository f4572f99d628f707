"""The built-in rules. Ids, conditions and severities are fixed by the scan semantics;
the explanatory texts are ours."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions import content as C
from fleetscan.functions import paths as P
from fleetscan.functions.text import contains_any, first_match, strip
from fleetscan.rules import secrets as S
from fleetscan.rules.model import (
    PROJECT_HIT,
    FileRule,
    LineRule,
    ProjectRule,
    Registry,
    project_hit,
)

# --- secrets ---------------------------------------------------------------------


def _may_hold_secrets(f):
    """Sources and configuration; environment and lock files are meant to be elsewhere."""
    lock = P.basename(f.path).isin("package-lock.json")
    return P.has_extension(f.path, V.SCANNABLE_EXTENSIONS) & ~P.is_test_file(f.path) & ~lock


def _secret_rule(name, ord_, severity, blocking, confidence, what, may_match, pattern, secret):
    return LineRule(
        rule_id=f"secret/hardcoded-{name}",
        category="secret",
        severity=severity,
        blocking=blocking,
        confidence=confidence,
        prefix="SEC",
        detector="secret-detector",
        detector_ord=0,
        rule_ord=ord_,
        title=f"{what} written into the source",
        problem=f"{what} ({{detail}}) is part of the code itself.",
        why="Whoever can read the repository or the bundle can use it; it stays in the history.",
        steps=(
            "Revoke the value and issue a new one.",
            "Read it from the environment or a secret store at run time.",
        ),
        prompt=f"Replace the hard-coded {what.lower()} by a value read from the environment.",
        file_when=lambda f: _may_hold_secrets(f) & may_match(f.content),
        line_when=lambda l: may_match(l.text) & l.text.rlike(pattern),
        found=secret,
        shows="masked",
    )


HARDCODED_KEY = _secret_rule(
    "api-key", 0, "critical", True, "high", "A vendor API key",
    lambda text: text.rlike(S.VENDOR_HINT), S.VENDOR_KEY,
    lambda l: first_match(l.text, S.VENDOR_KEY),
)
HARDCODED_JWT = _secret_rule(
    "jwt", 1, "high", True, "medium", "A signed token",
    lambda text: text.contains(S.JWT_HINT), S.JWT,
    lambda l: first_match(l.text, S.JWT),
)
HARDCODED_CREDENTIAL = _secret_rule(
    "credential", 2, "high", False, "low", "A credential",
    lambda text: text.rlike(S.QUOTED_VALUE), S.ASSIGNMENT,
    lambda l: F.regexp_extract(l.text, S.ASSIGNMENT, 1),
)

ENV_NOT_IGNORED = ProjectRule(
    rule_id="secret/env-not-ignored",
    category="secret",
    severity="critical",
    blocking=True,
    confidence="high",
    prefix="SEC",
    detector="secret-detector",
    detector_ord=0,
    rule_ord=3,
    title="Environment file is not ignored by git",
    problem="The project has an environment file that its .gitignore does not list.",
    why="The next commit may publish every value in it.",
    steps=("Add `.env` to .gitignore.", "If it was committed before, replace the values."),
    auto_fix=True,
    hits=lambda p: project_hit(p("has_env_file") & ~p("env_listed"), file=F.lit(".gitignore")),
)

# --- browser exposure ----------------------------------------------------------------

ADMIN_KEY_IN_CLIENT = LineRule(
    rule_id="frontend_exposure/service-role-key",
    category="frontend_exposure",
    severity="critical",
    blocking=True,
    confidence="high",
    prefix="FE",
    detector="frontend-exposure-detector",
    detector_ord=1,
    rule_ord=0,
    title="Administrative database key in browser code",
    problem="Code that runs in the browser refers to the service role key.",
    why="Visitors can read the key and act as the database administrator.",
    steps=(
        "Use the public key in the browser.",
        "Move administrative calls to a server route and call that route.",
    ),
    file_when=lambda f: f.is_code
    & C.is_client(f.path, f.content)
    & contains_any(f.content, V.ADMIN_KEY_MARKERS),
    line_when=lambda l: contains_any(l.text, V.ADMIN_KEY_MARKERS),
)

PUBLIC_SECRET = LineRule(
    rule_id="frontend_exposure/public-secret-var",
    category="frontend_exposure",
    severity="high",
    blocking=True,
    confidence="high",
    prefix="FE",
    detector="frontend-exposure-detector",
    detector_ord=1,
    rule_ord=1,
    title="Secret under a public variable name",
    problem="The variable {detail} sounds secret but carries the public prefix.",
    why="Variables with that prefix are copied into the bundle every visitor downloads.",
    steps=(
        "Rename the variable without the public prefix, in code and environment.",
        "Use it on the server only.",
    ),
    file_when=lambda f: f.is_code
    & C.is_client(f.path, f.content)
    & f.content.rlike("(?i)NEXT_PUBLIC_"),
    line_when=lambda l: l.text.rlike(V.PUBLIC_SECRET_PATTERN),
    found=lambda l: first_match(l.text, V.PUBLIC_SECRET_PATTERN),
    shows="found",
)

# --- routes ------------------------------------------------------------------------------


def _missing_auth(severity, blocking, when):
    return FileRule(
        rule_id="auth/missing-route-auth",
        category="auth",
        severity=severity,
        blocking=blocking,
        confidence="medium",
        prefix="AUTH",
        detector="missing-auth-detector",
        detector_ord=2,
        rule_ord=0,
        title="API route without a sign-in check",
        problem="The route changes data or serves a sensitive path, yet nothing in it checks the caller.",
        why="Anyone who knows the address can call it.",
        steps=(
            "Read the session at the start of the handler.",
            "Answer 401 when there is none.",
        ),
        prompt="Add a session check at the start of this route handler and answer 401 without one.",
        when=lambda f: f.is_api_route & when(f) & ~C.has_auth(f.content),
    )


MISSING_AUTH_SENSITIVE = _missing_auth("critical", True, lambda f: f.is_risky_route)
MISSING_AUTH_MUTATING = _missing_auth(
    "high", False, lambda f: ~f.is_risky_route & C.has_mutating_handler(f.content)
)

MISSING_VALIDATION = FileRule(
    rule_id="validation/missing-body-validation",
    category="validation",
    severity="high",
    blocking=False,
    confidence="medium",
    prefix="VAL",
    detector="missing-validation-detector",
    detector_ord=3,
    rule_ord=0,
    title="Request body used unchecked",
    problem="The route reads the request body and never checks its shape.",
    why="Unexpected input can crash the handler or slip past its checks.",
    steps=(
        "Declare a schema for the body.",
        "Parse the body with it before using any field.",
    ),
    prompt="Declare a schema for the body of this route and parse the body with it first.",
    when=lambda f: f.is_api_route & C.reads_body(f.content) & ~C.has_validation(f.content),
)

MISSING_ROLE_CHECK = FileRule(
    rule_id="authorization/missing-role-check",
    category="authorization",
    severity="high",
    blocking=False,
    confidence="medium",
    prefix="AUTHZ",
    detector="missing-authorization-detector",
    detector_ord=4,
    rule_ord=0,
    title="Admin route without a role check",
    problem="The route asks who the caller is but not whether the caller may do this.",
    why="Every signed-in account can use it, not only administrators.",
    steps=("Check the caller's role after the session check.", "Answer 403 when it is missing."),
    prompt="Add a role check after the session check of this admin route; answer 403 without it.",
    when=lambda f: f.is_api_route
    & f.is_admin_route
    & C.has_auth(f.content)
    & ~C.has_authorization(f.content),
)

# --- dependencies ---------------------------------------------------------------------------


def _lifecycle_hits(p):
    """One hit per lifecycle script, in the fixed order of the script names."""
    scripts = p("manifest_scripts")
    hits = []
    for i, key in enumerate(V.LIFECYCLE_SCRIPTS):
        shown = F.coalesce(F.try_element_at(scripts, F.lit(key)), F.lit("null"))
        hit = F.struct(
            p("manifest_path").alias("file"),
            F.concat(F.lit(f'"{key}": "'), shown, F.lit('"')).alias("evidence"),
            F.lit(key).alias("detail"),
            F.lit(i).alias("ordinal"),
        )
        found = F.coalesce(F.map_contains_key(scripts, key), F.lit(False))
        empty = F.array().cast(f"array<{PROJECT_HIT}>")
        hits.append(F.when(found, F.array(hit).cast(f"array<{PROJECT_HIT}>")).otherwise(empty))
    return F.concat(*hits)


LIFECYCLE_SCRIPT = ProjectRule(
    rule_id="dependency/risky-install-script",
    category="dependency",
    severity="high",
    blocking=False,
    confidence="medium",
    prefix="DEP",
    detector="dependency-detector",
    detector_ord=5,
    rule_ord=0,
    title="Script runs on install: {detail}",
    problem="The package manifest has a {detail} script, which runs by itself on every install.",
    why="Such scripts are a common way to run foreign code on developer and build machines.",
    steps=("Check that the {detail} script is needed.", "Prefer a command people run on purpose."),
    hits=_lifecycle_hits,
)

MANY_DEPENDENCIES = ProjectRule(
    rule_id="dependency/excessive-dependencies",
    category="dependency",
    severity="low",
    blocking=False,
    confidence="high",
    prefix="DEP",
    detector="dependency-detector",
    detector_ord=5,
    rule_ord=1,
    title="{detail} direct dependencies",
    problem="The package manifest names {detail} direct dependencies.",
    why="Each one is code to trust, update and watch.",
    steps=("List the dependencies no source imports.", "Remove them."),
    hits=lambda p: project_hit(
        p("manifest_dependency_count") > V.MAX_DIRECT_DEPENDENCIES,
        file=p("manifest_path"),
        evidence=F.concat(
            p("manifest_dependency_count").cast("string"), F.lit(" direct dependencies")
        ),
        detail=p("manifest_dependency_count"),
    ),
)

# --- code quality ------------------------------------------------------------------------------

HUGE_FILE = FileRule(
    rule_id="code_quality/huge-file",
    category="code_quality",
    severity="low",
    blocking=False,
    confidence="high",
    prefix="QUAL",
    detector="codebase-mess-detector",
    detector_ord=6,
    rule_ord=-1,
    title="Very long file",
    problem="The file has {detail} lines.",
    why="Long files mix concerns and are hard to review.",
    steps=("Split it by concern.", "Move shared helpers to a module of their own."),
    prompt="Split this file into smaller modules, each with one concern.",
    when=lambda f: f.is_code & (f.n_lines > V.MAX_FILE_LINES),
    lines_evidence=True,
)

EMPTY_CATCH = LineRule(
    rule_id="code_quality/empty-catch",
    category="code_quality",
    severity="medium",
    blocking=False,
    confidence="medium",
    prefix="QUAL",
    detector="codebase-mess-detector",
    detector_ord=6,
    rule_ord=1,
    title="Errors swallowed",
    problem="An error is caught here and nothing is done with it.",
    why="The program goes on as if nothing had happened, and nobody learns of the failure.",
    steps=("Report or handle the error.", "If it may be ignored, say why in a comment."),
    prompt="Handle or report the error caught in this empty catch block.",
    file_when=lambda f: f.is_code & f.content.contains("catch"),
    line_when=lambda l: l.text.contains("catch")
    & (l.text.contains("{}") | F.coalesce(strip(l.following) == "}", F.lit(False))),
)

CONSOLE_LOG = LineRule(
    rule_id="code_quality/console-log",
    category="code_quality",
    severity="low",
    blocking=False,
    confidence="high",
    prefix="QUAL",
    detector="codebase-mess-detector",
    detector_ord=6,
    rule_ord=2,
    title="Debug output left in",
    problem="A console.log call was left in the code.",
    why="It fills the console in production and may print data that should stay private.",
    steps=("Remove the call.",),
    auto_fix=True,
    file_when=lambda f: f.is_code & f.content.contains("console.log("),
    line_when=lambda l: l.text.contains("console.log("),
)

EXCESSIVE_ANY = ProjectRule(
    rule_id="code_quality/excessive-any",
    category="code_quality",
    severity="medium",
    blocking=False,
    confidence="high",
    prefix="QUAL",
    detector="codebase-mess-detector",
    detector_ord=6,
    rule_ord=3,
    tail=1,
    title="Type checks switched off in many places",
    problem="The project uses the type any {detail} times.",
    why="Where any is used the compiler checks nothing, so mistakes show only at run time.",
    steps=("Give the values real types.", "Use unknown where the type is open."),
    hits=lambda p: project_hit(
        p("any_total") > V.MAX_ANY_USES,
        evidence=F.concat(p("any_total").cast("string"), F.lit(" uses of any in the project")),
        detail=p("any_total"),
    ),
)


def _may_name_a_local_host(text):
    """Cheap and never wrong when it says no."""
    return contains_any(text, V.LOCAL_NUMBER_HINTS) | text.rlike("(?i)localhost")


LOCAL_HOST = LineRule(
    rule_id="code_quality/hardcoded-localhost",
    category="code_quality",
    severity="medium",
    blocking=False,
    confidence="high",
    prefix="QUAL",
    detector="hardcoded-localhost-detector",
    detector_ord=7,
    rule_ord=0,
    title="Local or private address in the code",
    problem="The address {detail} is reachable only on one machine or network.",
    why="After deployment nothing answers there.",
    steps=(
        "Read the address from the environment.",
        "Set a public address where the program is deployed.",
        "Name the variable in the example environment file.",
    ),
    prompt="Replace this local address by a value from configuration, one per environment.",
    file_when=lambda f: f.is_app_code & _may_name_a_local_host(f.content),
    line_when=lambda l: _may_name_a_local_host(l.text) & l.text.rlike(V.LOCAL_HOST_PATTERN),
    found=lambda l: first_match(l.text, V.LOCAL_HOST_PATTERN),
)

# --- project structure ---------------------------------------------------------------------------


def _structure(name, ord_, severity, confidence, title, problem, why, steps, when, **extra):
    return ProjectRule(
        rule_id=f"structure/missing-{name}",
        category="structure",
        severity=severity,
        blocking=False,
        confidence=confidence,
        prefix="STRUCT",
        detector="project-structure-detector",
        detector_ord=8,
        rule_ord=ord_,
        title=title,
        problem=problem,
        why=why,
        steps=steps,
        hits=lambda p: project_hit(when(p)),
        **extra,
    )


MISSING_GITIGNORE = _structure(
    "gitignore", 0, "high", "high",
    "No .gitignore",
    "The project root has no .gitignore.",
    "Packages, build output and environment files end up in the repository.",
    ("Create .gitignore in the root.", "List packages, build output and environment files."),
    lambda p: ~p("has_gitignore"),
)
MISSING_README = _structure(
    "readme", 1, "low", "high",
    "No README.md",
    "The project root has no README.md.",
    "Newcomers cannot tell what the project is or how to run it.",
    ("Create README.md.", "Say what the project does and how to start it."),
    lambda p: ~p("has_readme"),
    prompt="Write a README.md for this project from its code.",
)
MISSING_ENV_EXAMPLE = _structure(
    "env-example", 2, "low", "high",
    "No example environment file",
    "There is an environment file but no .env.example.",
    "Others cannot know which variables to set.",
    ("Create .env.example.", "Copy the names from .env and leave the values out."),
    lambda p: p("has_env_file") & ~p("has_env_example"),
    auto_fix=True,
)
MISSING_TESTS = _structure(
    "tests", 3, "low", "low",
    "No tests",
    "Neither a test runner nor a test script is declared.",
    "Every change has to be checked by hand.",
    ("Add a test runner.", "Write tests next to the code and a script that runs them."),
    lambda p: ~p("has_tests"),
)

BUILTIN_RULES = [
    HARDCODED_KEY,
    HARDCODED_JWT,
    HARDCODED_CREDENTIAL,
    ENV_NOT_IGNORED,
    ADMIN_KEY_IN_CLIENT,
    PUBLIC_SECRET,
    MISSING_AUTH_SENSITIVE,
    MISSING_AUTH_MUTATING,
    MISSING_VALIDATION,
    MISSING_ROLE_CHECK,
    LIFECYCLE_SCRIPT,
    MANY_DEPENDENCIES,
    HUGE_FILE,
    EMPTY_CATCH,
    CONSOLE_LOG,
    EXCESSIVE_ANY,
    LOCAL_HOST,
    MISSING_GITIGNORE,
    MISSING_README,
    MISSING_ENV_EXAMPLE,
    MISSING_TESTS,
]


def default_registry() -> Registry:
    """A registry holding the built-in rules."""
    return Registry(BUILTIN_RULES)
