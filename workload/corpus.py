"""A fleet of code projects derived from the ``documents`` table.

Every document becomes one file: a path and a leading snippet chosen by the document's
kind, followed by the document's whole text. Sources 0 to 5 together form one project that
holds about a third of all files; every other source splits into projects of four files, so
their number grows with the table. Each project gets a set of root files on top. The same
rules are written as SQL in :mod:`workload.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscan.plans.reuse import once
from fleetscan.plans.sizing import own_folder, spread

KINDS = 16

# kind -> path; {id} is the document id. Kind 3 has a Windows path on purpose.
PATHS = {
    0: "app/api/admin/r{id}/route.ts",
    1: "app/api/data/r{id}/route.ts",
    2: "app/api/admin/m{id}/route.ts",
    3: "app\\api\\users\\u{id}\\route.ts",
    4: "components/c{id}.tsx",
    5: "pages/p{id}.tsx",
    6: "src/l{id}.ts",
    7: "src/__tests__/t{id}.ts",
    8: "src/e{id}.ts",
    9: "src/a{id}.ts",
    10: "lib/h{id}.js",
    11: "node_modules/x{id}/index.js",
    12: "docs/d{id}.md",
    13: "src/s{id}.ts",
    14: "pkg{id}/package.json",
    15: "cfg{id}/.env",
}

# kind -> snippet; kinds 9, 10, 13 and 14 vary by document, see below.
SNIPPETS = {
    0: "export async function POST(req) {\n  const body = await req.json()\n  save(body)\n}",
    1: "export async function POST(req) {\n  const session = await getServerSession()\n"
    "  const body = schema.parse(await req.json())\n}",
    2: "export async function GET() {\n  const session = await getServerSession()\n}",
    3: "export async function GET() {\n  return list()\n}",
    4: '"use client"\nconst key = process.env.SERVICE_ROLE_KEY\n\u00a0\tconst again = service_role \r',
    5: "const hidden = process.env.NEXT_PUBLIC_app_SECRET_key\nconst two = NEXT_PUBLIC_X",
    6: 'const base = "http://LocalHost:3000"\n  console.log(base)\t\n'
    'const lan = ["10.0.0.7", "192.168.300.1"]\nconst near = xlocalhost + "172.20.1.9"',
    7: 'const base = "http://localhost:3000"\nconsole.log(base)',
    8: "try { a() } catch (e) {}\ntry { b() } catch (e) {\n \t}\ntry { c() } catch (e) { d() }",
    11: "console.log('third party')",
    12: "see http://localhost:3000",
    15: "# settings\n\nDB_URL=postgres://db\nNAME = a=b\r\nEMPTY=\nplain words",
}

ANY_LINE = "const value: any = many + anyone + $any\n"
FILLER_LINE = "let filler = 0\n"
MUTED = (
    "// fleetscan-disable-next-line\nconsole.log(1)\nconsole.log(2) // fleetscan-disable-line\n"
    "console.log(3)\nconsole.log(4)"
)
MUTED_FILE = "// fleetscan-disable-file\n"

GITIGNORE = (
    "# output\n*.log\n\ndocs/\nsrc/e*.ts\n!src/e*7.ts\n/CFG*/\n"
    # lines as people write them: unclosed, backwards, cut short; none stops the others
    "foo[\n[z-a].ts\nx\\\n\\#x\n\\!x\na{b\n[[:nope:]].md\nsrc/[!a-z]*.ts\nlib/h[[:digit:]]*3.js\n"
    # many wildcards in one line: neither may stall the others, nor match what it does not
    "*r*o*u*t*e*.*t*s*x*q\nlib/**/h*1*1*.j*s*\n"
)
GITIGNORE_ENV = "  .env\t\n"
ENV_TEXT = "# local values\n\nDB_URL=postgres://db\nTOKEN=a=b\r\nEMPTY=\nplain words"
DEPENDENCY_COUNT = 85


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_folder(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kind_of(doc_id: Column) -> Column:
    return (F.floor(doc_id / 20) % KINDS).cast("int")


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, "([0-9]+)", 1).cast("int")


def project_of(source: Column, doc_id: Column) -> tuple[Column, Column]:
    """Project id and project number of a document."""
    number, group = source_number(source), F.floor(doc_id / 80).cast("int")
    big = number < 6
    project = F.when(big, "mono").otherwise(F.concat(source, F.lit("-"), group.cast("string")))
    return project, F.when(big, 1).otherwise(number + group * 7)


def _fill(template: str, value: Column) -> Column:
    before, after = template.split("{id}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def json_text(text: Column) -> Column:
    """The inside of a JSON string, by steps that every engine takes alike: backslashes, quotes and
    line ends are escaped, other controls become spaces."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.regexp_replace(out, r"[\x00-\x1f]", " ")


def document_files(docs: DataFrame) -> DataFrame:
    """One file per document; ``doc_id`` and ``text`` come along for queries on later versions."""
    kinds, columns = _document_columns()
    return spread(docs).select(*kinds).select(*columns)


@once
def _document_columns() -> tuple[list, list]:
    kind, doc, text = F.col("kind"), F.col("doc_id"), F.col("text")
    path = F.when(F.lit(False), "")
    for k, template in PATHS.items():
        path = path.when(kind == k, _fill(template, doc))
    content = F.when(F.lit(False), "")
    for k, snippet in SNIPPETS.items():
        content = content.when(kind == k, F.concat(F.lit(snippet + "\n"), text))
    content = (
        content.when(
            kind == 9,
            F.concat(F.repeat(F.lit(ANY_LINE), (F.lit(5) + doc % 5 * 5).cast("int")), text),
        )
        .when(
            kind == 10,
            F.concat(F.repeat(F.lit(FILLER_LINE), (F.lit(493) + doc % 11).cast("int")), text),
        )
        .when(
            kind == 13,
            F.concat(
                F.when(doc % 3 == 1, MUTED_FILE).otherwise(""), F.lit(MUTED + "\n"), text
            ),
        )
        .when(
            kind == 14,
            F.concat(
                F.lit('{"scripts": {"postinstall": "node x.js", "install": "make"}, "about": "'),
                json_text(text),
                F.lit('"}'),
            ),
        )
    )
    project, _ = project_of(F.col("source"), doc)
    kinds = ["source", "doc_id", "text", kind_of(doc).alias("kind")]
    columns = [
        project.alias("project_id"),
        F.translate(path, "\\", "/").alias("path"),
        content.alias("content"),
        "doc_id",
        "text",
    ]
    return kinds, columns


def _root_file(path: str, when: Column, content: Column) -> Column:
    return F.when(
        when, F.array(F.struct(F.lit(path).alias("path"), content.alias("content")))
    ).otherwise(F.array().cast("array<struct<path:string,content:string>>"))


def manifest_text(s: Column) -> Column:
    """The root manifest of project number ``s``; some are broken."""
    many = ",".join(f'"dep{i}":"1.0.{i}"' for i in range(DEPENDENCY_COUNT))
    framework = (
        F.when(s % 4 == 0, '"next":"^14.0.0"')
        .when(s % 4 == 1, '"vite":"~5.1.0"')
        .when(s % 4 == 2, '"express":"4.18.2"')
        .otherwise('"left":"1.0.0"')
    )
    scripts = (
        F.when(s % 5 == 2, '"preinstall":"node pre.js","build":"tsc"')
        .when(s % 5 == 3, '"test:unit":"vitest run"')
        .otherwise('"build":"tsc"')
    )
    text = F.concat(
        F.lit('{"name":"app","scripts":{'),
        scripts,
        F.lit('},"dependencies":{'),
        framework,
        F.when(s % 10 == 7, F.lit("," + many)).otherwise(""),
        F.lit('},"devDependencies":{'),
        F.when(s % 2 == 0, '"vitest":"1.0.0"').otherwise(""),
        F.lit('},"engines":{"node":">=18"}}'),
    )
    return (
        F.when(s % 20 == 13, F.lit('{"name": broken'))
        .when(s % 20 == 16, F.lit('{"scripts": "none", "dependencies": {"next": ""}}'))
        .when(s % 20 == 18, F.lit("null"))
        .otherwise(text)
    )


def root_files(docs: DataFrame) -> DataFrame:
    """The root files of every project. Their keys are a few bytes and arrive in few pieces, what is
    made of them is not."""
    keys, files = _root_columns()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.select(*keys).distinct().repartition(cores, "project_id").select(*files)


@once
def _root_columns() -> tuple[list, list]:
    s = F.col("s")
    ignore = F.concat(F.lit(GITIGNORE), F.when(s % 4 == 3, GITIGNORE_ENV).otherwise(""))
    files = F.concat(
        _root_file("package.json", F.lit(True), manifest_text(s)),
        _root_file("tsconfig.json", s % 3 == 0, F.lit("{}")),
        _root_file(".gitignore", s % 2 == 1, ignore),
        _root_file(".env", s % 3 == 1, F.lit(ENV_TEXT)),
        _root_file(".env.example", s % 6 == 1, F.lit("DB_URL=")),
        _root_file("README.md", s % 5 == 0, F.lit("# app")),
        _root_file("pnpm-lock.yaml", s % 7 == 0, F.lit("lock")),
        _root_file("yarn.lock", s % 7 == 1, F.lit("lock")),
    )
    project, number = project_of(F.col("source"), F.col("doc_id"))
    return [project.alias("project_id"), number.alias("s")], ["project_id", F.inline(files)]


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfiltered listing: ``project_id, path, content``."""
    docs = documents(spark, sf_dir)
    return document_files(docs).drop("doc_id", "text").unionByName(root_files(docs))
