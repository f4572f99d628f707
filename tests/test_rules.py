"""Every rule on small projects, positive, negative and at its limits; one scan for all."""

import json

import pytest

from fleetscan import ScanConfig, scan

POST = "export async function POST(req) {\n  save()\n}"
MANIFEST = {"name": "x", "devDependencies": {"vitest": "1"}}
CLEAN = {
    "package.json": json.dumps(MANIFEST), ".gitignore": "", "README.md": "", "src/x.ts": "ok"
}


def deps(n):
    return json.dumps({"dependencies": {f"d{i}": "1" for i in range(n)}})


CASES = {
    # name: files, expected [(rule, file, line)], in any order; structure rules are left out
    "long505": ({"a.ts": "x\n" * 504 + "x"}, [("code_quality/huge-file", "a.ts", None)]),
    "long500": ({"a.ts": "x\n" * 499 + "x"}, []),
    "long500_newline": ({"a.ts": "x\n" * 500}, [("code_quality/huge-file", "a.ts", None)]),
    "long_mjs": ({"a.mjs": "x\n" * 600}, []),
    "catch_next": ({"a.ts": "try {} catch (e) {\n}\n"}, [("code_quality/empty-catch", "a.ts", 1)]),
    "catch_two": (
        {"a.js": "a()\n} catch (e) {\n \t}\r\nb()"}, [("code_quality/empty-catch", "a.js", 2)]
    ),
    "catch_last": ({"a.ts": "} catch (e) {"}, []),
    "catch_handled": ({"a.ts": "} catch (e) {\n  report(e)\n}"}, []),
    "log": ({"a.tsx": "\nconsole.log(1)"}, [("code_quality/console-log", "a.tsx", 2)]),
    "log_mjs": ({"a.mjs": "console.log(1)"}, []),
    "any20": ({"a.ts": "x: any\n" * 20}, []),
    "any21": (
        {"a.ts": "x: any\n" * 11, "b.ts": "any " * 10}, [("code_quality/excessive-any", None, None)]
    ),
    "any_parts": ({"a.ts": "many anyone any_ $any éany " * 10}, []),
    "any_accents": ({"a.ts": "éany anyé any-any " * 6}, [("code_quality/excessive-any", None, None)]),
    "install": (
        {"package.json": '{"scripts": {"postinstall": "node a.js"}}'},
        [("dependency/risky-install-script", "package.json", None)],
    ),
    "install_all": (
        {"package.json": '{"scripts": {"install": "a", "preinstall": "b", "postinstall": "c"}}'},
        [("dependency/risky-install-script", "package.json", None)] * 3,
    ),
    "dev_script": ({"package.json": '{"scripts": {"dev": "x"}, "dependencies": {"a": "1"}}'}, []),
    "deps80": ({"package.json": deps(80)}, []),
    "deps81": (
        {"package.json": deps(81)}, [("dependency/excessive-dependencies", "package.json", None)]
    ),
    "deps_nested": (  # no root manifest: the least deep one counts
        {"b/package.json": deps(85), "a/b/package.json": deps(3)},
        [("dependency/excessive-dependencies", "b/package.json", None)],
    ),
    "deps_root_first": ({"package.json": deps(3), "a/package.json": deps(85)}, []),
    "manifest_null": ({"package.json": "null"}, []),
    "manifest_scalar": ({"package.json": '{"scripts": 5, "dependencies": ' + deps(85)[17:]}, []),
    "manifest_broken": ({"package.json": "{'scripts': {'install': 'x'}}"}, []),
    "manifest_tail": ({"package.json": '{"scripts": {"install": "x"}} }'}, []),
    "manifest_cut": ({"package.json": '{"scripts": {"install": "x"}, "a": '}, []),
    "manifest_list": ({"package.json": '{"scripts": ["install"]}'}, []),
    "manifest_dup": ({"package.json": '{"scripts": {"install": "x"}, "scripts": {}}'}, []),
    "public_var": (
        {"pages/a.tsx": "\nuse(process.env.NEXT_PUBLIC_APP_SECRET_KEY)"},
        [("frontend_exposure/public-secret-var", "pages/a.tsx", 2)],
    ),
    "public_case": (
        {"a.tsx": "'use client'\nnext_public_password"},
        [("frontend_exposure/public-secret-var", "a.tsx", 2)],
    ),
    "role_client": (
        {"a.tsx": '"use client"\nconst k = SERVICE_ROLE_KEY'},
        [("frontend_exposure/service-role-key", "a.tsx", 2)],
    ),
    "role_both": (
        {"a.tsx": '"use client"\nNEXT_PUBLIC_SERVICE_ROLE_KEY'},
        [
            ("frontend_exposure/service-role-key", "a.tsx", 2),
            ("frontend_exposure/public-secret-var", "a.tsx", 2),
        ],
    ),
    "role_server": ({"lib/a.ts": "const k = SERVICE_ROLE_KEY"}, []),
    "role_pages_api": ({"pages/api/a.ts": "const k = SERVICE_ROLE_KEY"}, []),
    "local": ({"a.ts": "fetch('http://localhost:3000')"}, [("code_quality/hardcoded-localhost", "a.ts", 1)]),
    "local_six": (
        {
            "a.ts": "a 127.0.0.1\nb 10.0.0.5\nc 192.168.1.1\nd 172.16.0.1\ne [::1]:80",
            "b.mjs": "LOCALHOST",
        },
        [("code_quality/hardcoded-localhost", "a.ts", i) for i in range(1, 6)]
        + [("code_quality/hardcoded-localhost", "b.mjs", 1)],
    ),
    "local_none": (
        {
            "a.ts": "8.8.8.8\nxlocalhost\nlocalhosts\n172.32.0.1\n10.0.0\n192.168.1.999",
            "d.md": "localhost",
        },
        [],
    ),
    "local_tests": (
        {
            "a.test.ts": "localhost", "a.spec.js": "localhost", "__tests__/a.ts": "localhost",
            "src/__tests__/a.ts": "localhost", "a.ts": "localhost",
        },
        [("code_quality/hardcoded-localhost", "a.ts", 1)],
    ),
    "auth_none": ({"app/api/x/route.ts": POST}, [("auth/missing-route-auth", "app/api/x/route.ts", None)]),
    "auth_session": ({"app/api/x/route.ts": "await getServerSession()\n" + POST}, []),
    "auth_generic": (
        {"app/api/x/route.ts": "getUser()\n" + POST},
        [("auth/missing-route-auth", "app/api/x/route.ts", None)],
    ),
    "auth_path": (
        {"api/users/a.ts": "x"}, [("auth/missing-route-auth", "api/users/a.ts", None)]
    ),
    "auth_get": ({"app/api/x/route.ts": "export async function GET() {}"}, []),
    "auth_method": (
        {"pages/api/x.ts": "if (req.method === 'PUT') save()"},
        [("auth/missing-route-auth", "pages/api/x.ts", None)],
    ),
    "role_missing": (
        {"app/api/admin/route.ts": "await auth()\n" + POST},
        [("authorization/missing-role-check", "app/api/admin/route.ts", None)],
    ),
    "role_present": ({"app/api/admin/route.ts": "await auth()\nif (user.role) {}\n" + POST}, []),
    "body_raw": (
        {"app/api/x/route.ts": "await auth()\nconst b = await req.json()"},
        [("validation/missing-body-validation", "app/api/x/route.ts", None)],
    ),
    "body_parsed": ({"app/api/x/route.ts": "await auth()\nschema.parse(await req.json())"}, []),
    "body_joined": ({"app/api/x/route.ts": "await auth()\nreq.body.join()"}, []),
    "secret_vendor": (
        {"a.ts": "const k = 'AKIA" + "ABCDEFGHIJKLMNOP'"}, [("secret/hardcoded-api-key", "a.ts", 1)]
    ),
    "secret_assigned": (
        {"a.ts": "x\nconst token = \"" + "0123456789abcdef" + '"'},
        [("secret/hardcoded-credential", "a.ts", 2)],
    ),
    "secret_env": ({".gitignore": " .env \r\n", ".env": "K=1", ".env.example": "K="}, []),
    "env_open": (
        {".gitignore": "dist\n.env.*", ".env.local": "K=1", ".env.example": "K="},
        [("secret/env-not-ignored", ".gitignore", None)],
    ),
    "mute_next": ({"a.ts": "// fleetscan-disable-next-line\nconsole.log(1)"}, []),
    "mute_same": ({"a.ts": "console.log(1) // fleetscan-disable-line"}, []),
    "mute_first": (
        {"a.ts": "console.log(1)\n// fleetscan-disable-next-line"},
        [("code_quality/console-log", "a.ts", 1)],
    ),
    "mute_file": (
        {"app/api/admin/a.ts": "console.log(1)\n// fleetscan-disable-file"},
        [("auth/missing-route-auth", "app/api/admin/a.ts", None)],
    ),
    "empty": ({"a.ts": ""}, []),
    "excluded": ({"node_modules/a.ts": "console.log(1)", "a.md": "console.log(1)"}, []),
}


@pytest.fixture(scope="module")
def result(make_files):
    projects = {name: CLEAN | fs for name, (fs, _) in CASES.items()} | {"bare": {"a.ts": ""}}
    del projects["deps_nested"]["package.json"]
    files = make_files(projects)
    return scan(files, ScanConfig(root="."))


@pytest.fixture(scope="module")
def found(result):
    out = {}
    for r in result.findings.collect():
        out.setdefault(r.project_id, []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    rows = [
        (r.rule_id, r.file, r.line)
        for r in found.get(name, [])
        if not r.rule_id.startswith("structure/")
    ]
    assert sorted(rows, key=str) == sorted(CASES[name][1], key=str)


def test_structure_rules(found):
    assert {r.rule_id for r in found["bare"]} == {
        "structure/missing-gitignore", "structure/missing-readme", "structure/missing-tests",
    }
    assert not [r for r in found.get("long500", []) if r.rule_id.startswith("structure/")]


def test_severity_follows_the_path(found):
    rows = {n: found[n][0] for n in ("auth_none", "auth_path")}
    assert (rows["auth_none"].severity, rows["auth_none"].deploy_blocking) == ("high", False)
    assert (rows["auth_path"].severity, rows["auth_path"].deploy_blocking) == ("critical", True)


def test_texts_carry_the_detail(found):
    (row,) = found["local"]
    assert "localhost" in row.plain_english_problem and row.evidence == "fetch('http://localhost:3000')"
    (row,) = found["secret_vendor"]
    assert row.evidence == "AKIA...MNOP" and "ABCDEF" not in row.plain_english_problem
    row = next(r for r in found["install"] if r.category == "dependency")
    assert row.evidence == '"postinstall": "node a.js"' and row.title.endswith("postinstall")
    assert "{detail}" not in " ".join(row.fix_steps)


def test_ids_are_unique_and_stable(found, result):
    ids = [r.id for rows in found.values() for r in rows]
    assert len(ids) == len(set(ids))
    assert sorted(ids) == sorted(r.id for r in result.findings.select("id").collect())


def test_detector_errors(result):
    rows = {r.project_id: r.message for r in result.errors.collect()}
    assert set(rows) == {"manifest_null", "manifest_scalar"}
    assert "null" in rows["manifest_null"]


def test_fused_scores_equal_scores_of_findings(result):
    from fleetscan import score, summary

    fused = {r.project_id: (r.score, r.deploy_status, r.total, r.lines_scanned) for r in result.projects.collect()}
    scores = {r.project_id: r for r in score(result.findings, result.facts).collect()}
    sums = {r.project_id: r for r in summary(result.findings, result.files).collect()}
    assert fused == {
        p: (scores[p].score, scores[p].deploy_status, sums[p].total, sums[p].lines_scanned) for p in fused
    }
