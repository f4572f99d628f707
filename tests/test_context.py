import json

from fleetscan import project_context

APP = {
    # The seven files of a small web application with an unprotected admin route.
    "app/api/admin/route.ts": "import { save } from '@/lib/save'\n\nexport async function POST(req: Request) {\n"
    "  // no checks\n  const body = await req.json()\n  return save(body)\n}\n",
    "app/page.tsx": "export default function Page() {\n  return null\n}\n",
    "app/dashboard/page.tsx": "export default function Page() {\n  return null\n}\n",
    "lib/supabase.ts": "export const admin = client(process.env.SERVICE_ROLE_KEY)\n",
    "next.config.js": "module.exports = {}\n",
    "package.json": json.dumps({"scripts": {"dev": "next dev"}, "dependencies": {"next": "^14.0.0"}}),
    "tsconfig.json": "{}",
}


def contexts(make_files, projects):
    return {r.project_id: r for r in project_context(make_files(projects)).collect()}


def test_small_application(make_files):
    (row,) = contexts(make_files, {"p": APP}).values()
    assert (row.framework, row.language, row.package_manager) == ("nextjs", "typescript", "npm")
    assert row.nextjs_version == "14.0.0" and row.dependencies == {"next": "^14.0.0"}
    assert not (row.has_gitignore or row.has_env_file or row.has_readme or row.has_tests)


def test_fields(make_files):
    def pkg(**kw):
        return {"package.json": json.dumps(kw)}

    rows = contexts(
        make_files,
        {
            "vite_dev": pkg(devDependencies={"vite": "5"}),
            "vite_over_express": pkg(dependencies={"vite": "5", "express": "4"}),
            "express": pkg(dependencies={"express": "4"}),
            "empty_next": pkg(dependencies={"next": "", "express": "4"}),
            "runner": pkg(devDependencies={"mocha": "1"}),
            "script": pkg(scripts={"e2e:test": "x"}),
            "command_only": pkg(scripts={"check": "jest test"}),
            "node": pkg(engines={"node": ">=18"}),
            "broken": {"package.json": "{"},
            "nested": {"a/package.json": '{"dependencies": {"next": "1"}}', "a/README.md": ""},
            "pnpm": {"pnpm-lock.yaml": "", "yarn.lock": ""},
            "yarn": {"yarn.lock": ""},
            "plain_ignore": {"gitignore": ""},
            "env_local": {".env.local": "", ".env.example": "", "README.md": ""},
        },
    )
    assert rows["vite_dev"].framework == rows["vite_over_express"].framework == "vite"
    assert rows["express"].framework == rows["empty_next"].framework == "express"
    assert rows["broken"].framework == rows["nested"].framework == "unknown"
    assert rows["broken"].dependencies == {} and not rows["nested"].has_readme
    assert rows["runner"].has_tests and rows["script"].has_tests
    assert not rows["command_only"].has_tests
    assert rows["node"].node_version == ">=18" and rows["pnpm"].node_version is None
    assert (rows["pnpm"].package_manager, rows["yarn"].package_manager) == ("pnpm", "yarn")
    assert rows["plain_ignore"].has_gitignore and rows["plain_ignore"].language == "javascript"
    assert rows["env_local"].has_env_file and rows["env_local"].has_env_example
    assert rows["env_local"].has_readme
