"""Ignore rules as data: parse patterns into a small table, decide per path.

The semantics are those git documents: rules apply in order and the last match wins,
``!`` takes a path back in, a slash at the start or inside anchors the pattern to the
root, a slash at the end restricts it to directories, and nothing below an ignored
directory can be taken back.

Matching takes time in proportion to pattern and path, whatever the pattern: a wildcard takes
the first place where the fixed characters behind it match and never comes back to it, which is
right since all that follows may only start later; only the last directory wildcard of a pattern
tries one directory after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscan.plans.reuse import once
from fleetscan.plans.sizing import small, stored

# Rules of different rule sets, their characters, projects, and ignored paths (and their
# characters) that may be broadcast.
BROADCAST_RULES = 200_000
BROADCAST_CHARS = 16_000_000
BROADCAST_PROJECTS = 500_000
BROADCAST_PATHS = 1_000_000
BROADCAST_PATH_CHARS = 64_000_000

RULE = ["negated", "dir_only", "kind", "arg", "regex"]
RULES_TYPE = (
    "array<struct<negated:boolean,dir_only:boolean,kind:string,arg:string,regex:string>>"
)

# The parts of a pattern, first match first: directory wildcards, wildcards, escapes, a backslash
# at the end, a closed bracket, any other character. Each is translated on its own, so
# that what comes out is a valid regular expression whatever goes in.
_PARTS = (
    r"(?s)^(?:\*\*/)+|/(?:\*\*/)+|/\*\*\z|\*+|\?|\\.|\\\z"
    r"|\[[!^]?\]?(?:\[:[a-z]+:\]|\\.|[^\]\\])*\]|."
)
_MEMBERS = r"(?s)\[:[a-z]+:\]|(?:\\.|[^\\])-(?:\\.|[^\\])|\\.|."
_NOTHING = "(?!)"

# What the named classes of a bracket mean (fixed values of the POSIX standard).
_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "xdigit": r"\p{XDigit}",
}


def _quoted(char: Column) -> Column:
    """One character, escaped unless it is a letter, digit or beyond ASCII."""
    return F.when(char.rlike(r"(?s)\A[a-zA-Z0-9\x{80}-\x{10ffff}]\z"), char).otherwise(
        F.concat(F.lit("\\"), char)
    )


def _unescaped(member: Column) -> Column:
    return F.when(F.length(member) > 1, F.substr(member, F.lit(2))).otherwise(member)


def _member(member: Column, ignore_case: bool) -> Column:
    """One member of a bracket. A range that runs backwards and a class that is not known have no
    characters; where case is ignored, upper-case letters are letters."""
    known = F.lit("")
    for name, chars in _CLASSES.items():
        either = _CLASSES["alpha"] if ignore_case and name in ("upper", "lower") else chars
        known = F.when(member == f"[:{name}:]", F.lit(either)).otherwise(known)
    ends = F.regexp_extract(member, r"(?s)\A(\\.|[^\\])-(\\.|[^\\])\z", 1)
    low, high = _unescaped(ends), _unescaped(
        F.regexp_extract(member, r"(?s)\A(\\.|[^\\])-(\\.|[^\\])\z", 2)
    )
    span = F.when(low <= high, F.concat(_quoted(low), F.lit("-"), _quoted(high))).otherwise("")
    return (
        F.when(member.rlike(r"\A\[:[a-z]+:\]\z"), known)
        .when(ends != "", span)
        .otherwise(_quoted(_unescaped(member)))
    )


def _bracket(part: Column, ignore_case: bool) -> Column:
    inner = F.substr(part, F.lit(2), F.length(part) - 2)
    negated = inner.rlike(r"\A[!^]")
    inner = F.when(negated, F.substr(inner, F.lit(2))).otherwise(inner)
    members = F.transform(
        F.regexp_extract_all(inner, F.lit(_MEMBERS), F.lit(0)), lambda m: _member(m, ignore_case)
    )
    chars = F.array_join(members, "")
    return (
        F.when((chars == "") & negated, F.lit("[^/]"))
        .when(chars == "", F.lit(_NOTHING))
        .otherwise(
            F.concat(
                F.lit("(?!/)["), F.when(negated, F.lit("^")).otherwise(""), chars, F.lit("]")
            )
        )
    )


def _part(part: Column, ignore_case: bool) -> Column:
    """One character of a path segment."""
    return (
        F.when(part == "?", "[^/]")
        .when(part == "\\", "")  # nothing is left to escape
        .when(part.startswith("\\"), _quoted(F.substr(part, F.lit(2))))
        .when(part.startswith("[") & (F.length(part) > 1), _bracket(part, ignore_case))
        .otherwise(_quoted(part))
    )


# Up to any start of a segment; up to the first place in the segment; the end of the segment.
_TO_SEGMENT = r"(?s:.*?)(?<![^/])"
_ONCE_TO = "(?>[^/]*?"
_SEGMENT_END = r"(?=/|\z)"


@once
def _glob_regex(ignore_case: bool) -> Column:
    """The regular expression of pattern ``p``, its ``!`` and outer slashes removed.

    A run of fixed characters behind a star is a group that is entered once; behind the last
    star of a segment it ends with the segment. What stands between two directory wildcards is
    such a group too.
    """
    parts = F.regexp_extract_all(F.col("p"), F.lit(_PARTS), F.lit(0))
    n_dirs = F.size(F.filter(parts, lambda x: x.rlike(r"\A/?(?:\*\*/)+\z")))

    def step(state: Column, part: Column) -> Column:
        out, star, dirs = state["out"], state["star"], state["dirs"]
        segment = F.concat(out, F.when(star, _SEGMENT_END + ")").otherwise(""))
        closed = F.concat(segment, F.lit("/"), F.when(dirs > 0, ")").otherwise(""))
        opened = F.concat(F.when(dirs + 1 < n_dirs, "(?>").otherwise("(?:"), F.lit(_TO_SEGMENT))

        def to(text: Column, in_star: bool | Column, in_dirs: Column) -> Column:
            flag = F.lit(in_star) if isinstance(in_star, bool) else in_star
            return F.struct(text.alias("out"), flag.alias("star"), in_dirs.alias("dirs"))

        return (
            F.when(part.rlike(r"\A(?:\*\*/)+\z"), to(F.concat(out, opened), False, dirs + 1))
            .when(part.rlike(r"\A/(?:\*\*/)+\z"), to(F.concat(closed, opened), False, dirs + 1))
            .when(part == "/**", to(F.concat(closed, F.lit("(?s:.+)")), False, F.lit(0)))
            .when(part == "/", to(F.concat(segment, F.lit("/")), False, dirs))
            .when(
                part.rlike(r"\A\*+\z"),
                to(F.concat(out, F.when(star, ")").otherwise(""), F.lit(_ONCE_TO)), True, dirs),
            )
            .otherwise(to(F.concat(out, _part(part, ignore_case)), star, dirs))
        )

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("star"), F.lit(0).alias("dirs"))
    return F.aggregate(
        parts,
        start,
        step,
        lambda s: F.concat(
            F.when(F.col("anchored"), "").otherwise(_TO_SEGMENT),
            s["out"],
            F.when(s["star"], _SEGMENT_END + ")").otherwise(""),
            F.when(s["dirs"] > 0, ")").otherwise(""),
        ),
    )


def parse_rules(lines: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``project_id, seq, pattern`` lines to rules. Blank lines and comments are dropped.

    ``kind`` says how a rule is matched: most patterns are plain names, paths or
    ``*.extension`` and need no regular expression.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    text = F.regexp_replace("pattern", r"\r\z", "")
    text = F.regexp_replace(text, r"(?<!\\)\s+\z", "")
    rows = lines.select("project_id", "seq", fold(text).alias("p"))
    rows = rows.where((F.col("p") != "") & ~F.col("p").startswith("#"))
    negated = F.col("p").startswith("!")
    rows = rows.withColumn("negated", negated).withColumn(
        "p", F.when(negated, F.substr("p", F.lit(2))).otherwise(F.col("p"))
    )
    rows = rows.withColumn("dir_only", F.col("p").endswith("/"))
    rows = rows.withColumn("p", F.regexp_replace("p", r"/\z", ""))
    rows = rows.where("p != ''")
    rows = rows.withColumn("anchored", F.col("p").contains("/"))
    rows = rows.withColumn("p", F.regexp_replace("p", "^/", ""))
    special = F.col("p").rlike(r"[*?\[\\]")
    suffix = F.col("p").rlike(r"^\*[^*?\[\\/]+\z") & ~F.col("anchored")
    kind = (
        F.when(suffix, "suffix")
        .when(special, "glob")
        .when(F.col("anchored"), "path")
        .otherwise("name")
    )
    rows = rows.withColumn("kind", kind)
    plain = F.concat(F.lit(r"\Q"), F.col("p"), F.lit(r"\E"))
    regex = F.when(F.col("kind") == "path", plain).when(
        F.col("kind") == "name", F.concat(F.lit(_TO_SEGMENT), plain)
    )
    rows = rows.withColumn("regex", regex.otherwise(_glob_regex(ignore_case)))
    return rows.select(
        "project_id",
        "seq",
        "negated",
        "dir_only",
        "kind",
        F.when(F.col("kind") == "suffix", F.substr("p", F.lit(2)))
        .when(F.col("kind") == "glob", F.concat(F.lit("^"), "regex", F.lit(r"\z")))
        .otherwise(F.col("p"))
        .alias("arg"),
        "regex",
    )


def _ignore_texts(files: DataFrame) -> DataFrame:
    """``project_id, contents, text_id``: the root ``.gitignore`` of every project that has one."""
    ignore = files.where((F.col("path") == ".gitignore") & F.col("content").isNotNull())
    contents = F.sort_array(F.collect_list("content")).alias("contents")
    texts = ignore.groupBy("project_id").agg(contents)
    return texts.withColumn("text_id", F.sha2(F.to_json("contents"), 256))


def _parsed_texts(texts: DataFrame, ignore_case: bool) -> DataFrame:
    """The rules of each different text, by ``text_id``. Templates are shared by very many projects
    and parsing is costly for the size of a text, so each is parsed once, on all cores."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    different = texts.groupBy("text_id").agg(F.first("contents").alias("contents"))
    each = different.repartition(cores, "text_id").select("text_id", F.explode("contents").alias("content"))
    lines = each.select(
        F.col("text_id").alias("project_id"),
        F.posexplode(F.split("content", "\n", -1)).alias("seq", "pattern"),
    )
    return parse_rules(lines, ignore_case).withColumnRenamed("project_id", "text_id")


def ignore_rules(files: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Rules of every project's root ``.gitignore``."""
    texts = _ignore_texts(files)
    rules = _parsed_texts(texts, ignore_case)
    return texts.drop("contents").join(rules, "text_id").drop("text_id")


def file_rule_sets(files: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``project_id, set_id, rules`` as of :func:`_rule_sets`, of every project's root ``.gitignore``;
    only the project that names a set holds its rules. What grows with the projects is a row of
    two ids each."""
    texts = stored(_ignore_texts(files))
    rules = _parsed_texts(texts, ignore_case).withColumnRenamed("text_id", "project_id")
    alike = stored(_rule_sets(rules).withColumnsRenamed({"project_id": "text_id", "set_id": "alike"}))
    owners = texts.drop("contents").join(alike.select("text_id", "alike"), "text_id")
    sets = owners.groupBy("alike").agg(F.min("project_id").alias("set_id"))
    sets = sets.join(alike.where("text_id = alike").select("alike", "rules"), "alike")
    held = F.when(F.col("project_id") == F.col("set_id"), F.col("rules")).alias("rules")
    return owners.join(sets, "alike").select("project_id", "set_id", held)


def _shared_rules(spark: SparkSession, patterns, ignore_case: bool) -> Column:
    """The caller's patterns (F4) as a literal array of rules, the same for every project."""
    lines = spark.createDataFrame(
        [("", i, p) for i, p in enumerate(patterns)], "project_id string, seq int, pattern string"
    )
    rules = parse_rules(lines, ignore_case).select(*RULE).collect()
    if not rules:
        return F.array().cast(RULES_TYPE)
    literals = [F.struct(*[F.lit(r[c]).alias(c) for c in RULE]) for r in rules]
    return F.array(*literals).cast(RULES_TYPE)


def ancestors(path: Column) -> Column:
    """The path and all its parent directories, outermost first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def _matches(rule: Column, place: Column, is_dir: Column) -> Column:
    name = F.substring_index(place, "/", -1)
    hit = (
        F.when(rule.kind == "name", name == rule.arg)
        .when(rule.kind == "path", place == rule.arg)
        .when(rule.kind == "suffix", name.endswith(rule.arg))
        .otherwise(F.rlike(place, rule.arg))
    )
    return hit & (is_dir | ~rule.dir_only)


def _rule_sets(rules: DataFrame) -> DataFrame:
    """``project_id, set_id, rules``: each project's rules as one array. Projects with the
    same rules have the same ``set_id``, the smallest of their ids."""
    in_order = F.sort_array(F.collect_list(F.struct("seq", *RULE)))
    own = F.transform(in_order, lambda r: F.struct(*[r[c].alias(c) for c in RULE]))
    per_project = rules.groupBy("project_id").agg(own.cast(RULES_TYPE).alias("rules"))
    # templates are shared by very many projects: a digest is what they are grouped by
    key = F.sha2(F.to_json("rules"), 256)
    firsts = (
        per_project.withColumn("key", key)
        .groupBy("key")
        .agg(F.min("project_id").alias("set_id"))
    )
    return per_project.withColumn("key", key).join(firsts, "key").drop("key")


def with_ignored(
    files: DataFrame, rules: DataFrame, ignore_case: bool = True, exclude_patterns=()
) -> DataFrame:
    """``files`` with a boolean ``ignored``: the project's own rules, then the caller's."""
    return with_ignored_by_sets(files, _rule_sets(rules), ignore_case, exclude_patterns)


def with_ignored_by_sets(
    files: DataFrame, sets: DataFrame, ignore_case: bool = True, exclude_patterns=()
) -> DataFrame:
    """The same from ``sets(project_id, set_id, rules)``; the row whose project names its set holds
    the rules.

    Equal rule sets are one. Where sets and projects measure small they are broadcast, and paths
    are judged where their contents were read. Otherwise paths alone, without contents, meet
    their rules in a join that splits skewed projects; what comes back to the files is the list
    of ignored paths, broadcast if it measures small.
    """
    sets = stored(sets)
    distinct = sets.where(F.col("project_id") == F.col("set_id")).select("set_id", "rules")
    size = distinct.agg(
        F.coalesce(F.sum(F.size("rules")), F.lit(0)).alias("n"),
        F.coalesce(
            F.sum(F.aggregate("rules", F.lit(0), lambda n, r: n + F.length(r.arg) + F.length(r.regex))),
            F.lit(0),
        ).alias("chars"),
    ).first()
    shared = F.lit(None).cast(RULES_TYPE)
    if exclude_patterns:
        shared = _shared_rules(files.sparkSession, exclude_patterns, ignore_case)
    elif size.n == 0:
        return files.withColumn("ignored", F.lit(False))
    if size.n == 0:
        return _judged(files.withColumns({"rules": shared, "maybe": _any_of(shared)}), ignore_case)
    if exclude_patterns:
        distinct = distinct.withColumn("rules", F.concat("rules", shared))
    distinct = distinct.withColumn("maybe", _any_of(F.col("rules")))
    owners = sets.select("project_id", "set_id")
    if (
        size.n <= BROADCAST_RULES
        and size.chars <= BROADCAST_CHARS
        and small(owners, BROADCAST_PROJECTS)
    ):
        met = files.join(F.broadcast(owners), "project_id", "left")
        met = met.join(F.broadcast(distinct), "set_id", "left").drop("set_id")
        return _judged(_with_shared(met, shared, exclude_patterns), ignore_case)
    paths = files.select("project_id", "path")
    met = paths.join(owners, "project_id", "left").join(distinct, "set_id", "left")
    judged = _judged(_with_shared(met, shared, exclude_patterns), ignore_case)
    found = stored(judged.where("ignored").select("project_id", "path", "ignored").distinct())
    weight = found.agg(F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("chars")).first()
    if weight.chars <= BROADCAST_PATH_CHARS and small(found, BROADCAST_PATHS):
        found = F.broadcast(found)
    out = files.join(found, ["project_id", "path"], "left")
    return out.withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def _with_shared(met: DataFrame, shared: Column, exclude_patterns) -> DataFrame:
    """The caller's rules for projects that have none of their own."""
    if not exclude_patterns:
        return met
    return met.withColumns(
        {"rules": F.coalesce("rules", shared), "maybe": F.coalesce("maybe", _any_of(shared))}
    )


def _judged(met: DataFrame, ignore_case: bool) -> DataFrame:
    return met.withColumns({"ignored": _ignored(ignore_case)}).drop("rules", "maybe", "set_id")


def _any_of(rules: Column) -> Column:
    """One expression that matches every path some rule may ignore, and few others."""
    positive = F.filter(rules, lambda r: ~r.negated)
    joined = F.array_join(F.transform(positive, lambda r: r.regex), "|")
    return F.concat(F.lit("^(?:"), joined, F.lit(r")(?:/|\z)"))


@once
def _ignored(ignore_case: bool) -> Column:
    path = F.lower("path") if ignore_case else F.col("path")

    def decided(place: Column) -> Column:
        # The last matching rule counts.
        return F.aggregate(
            "rules",
            F.lit(False),
            lambda state, rule: F.when(
                _matches(rule, place, place != path), ~rule.negated
            ).otherwise(state),
        )

    # Most paths match nothing, which one expression per project tells; regexp_extract keeps
    # the compiled expression while it stays the same from row to row.
    maybe = F.call_function("regexp_extract", path, F.col("maybe"), F.lit(0)) != ""
    return F.when(maybe, F.exists(ancestors(path), decided)).otherwise(False)


def gitignore_filter(files: DataFrame, rules: DataFrame, ignore_case: bool = True) -> DataFrame:
    """files the rules leave in."""
    return with_ignored(files, rules, ignore_case).where(~F.col("ignored")).drop("ignored")
