"""Files of a tree as rows: discovery with ignore patterns, languages, decoding and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {
    **{e: (n, "source") for n, some in {"python": ".py .pyi", "typescript": ".ts", "tsx": ".tsx", "javascript": ".js .jsx .mjs .cjs", "go": ".go", "rust": ".rs", "java": ".java", "c": ".c .h", "cpp": ".cc .cpp .cxx .hpp .hh", "csharp": ".cs"}.items() for e in some.split()},
    **{e: ("markdown", "doc") for e in (".md", ".markdown")},
    **{e: (n, "config") for n, some in {"json": ".json", "yaml": ".yaml .yml", "toml": ".toml", "ini": ".ini .cfg"}.items() for e in some.split()},
}
FILES = "path string, language string, kind string, size long, mtime timestamp, sha256 string, text string"


def ignore_regex(pattern: str) -> str | None:
    """A regular expression for the paths that a line of an ignore file matches; None for blanks and comments."""
    p = pattern.rstrip("\n")
    if not p.strip() or p.startswith("#") or p.startswith("!"):
        return None
    p = p.strip()
    only_dir, p = p.endswith("/"), p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if only_dir else "(?:/.*)?$")


def language(path: Column) -> Column:
    """struct(language, kind), null for files that are neither code, documents nor configuration."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    known = F.create_map(*(x for e, (n, k) in LANGUAGES.items() for x in (F.lit(e), F.struct(F.lit(n).alias("language"), F.lit(k).alias("kind")))))
    env = (name == ".env") | F.startswith(name, F.lit(".env."))
    return F.when(env, F.struct(F.lit("env").alias("language"), F.lit("config").alias("kind"))).otherwise(F.element_at(known, suffix))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, most_bytes: int = 1_000_000, languages: list[str] | None = None) -> DataFrame:
    """FILES of all known files below root. Include patterns take the place of all ignore patterns. Texts are UTF-8,
    with replacement characters for what isn't."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Paths come as encoded URIs; a plus sign in them is one.
    plain, base = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root.rstrip("/") + "/"
    rel = F.substring(plain, F.locate(base, plain) + len(base), F.length(plain))
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    if include:
        rows = rows.filter(F.col("path").rlike("|".join(filter(None, map(ignore_regex, include)))))
    else:
        for p in filter(None, map(ignore_regex, ignore or [])):
            rows = rows.filter(~F.col("path").rlike(p))
    rows = rows.withColumn("l", language(F.col("path"))).filter(F.col("l").isNotNull() & (F.col("size") <= most_bytes))
    if languages:
        rows = rows.filter(F.col("l.language").isin(*languages, *(["tsx"] if "typescript" in languages else [])))
    return rows.select("path", "l.language", "l.kind", "size", "mtime", F.sha2("content", 256).alias("sha256"), F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


QUESTION = "id string, question string, kind string, target string, gold array<long>, gold_hops map<string,int>, gold_files array<string>, gold_file string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a file of JSON lines; blanks and lines that begin with # are passed over. A line that is no
    object, or asks nothing, is an error that names its place; an old gold_file counts as one of gold_files."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = lines.filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    q = F.from_json("line", QUESTION)
    where = F.concat(F.lit(f"{path}:"), (F.col("at") + 1).cast("string"), F.lit(" is no question"))
    out = lines.withColumn("q", q).withColumn("q", F.when(F.col("q.question").isNotNull(), F.col("q")).otherwise(F.raise_error(where)))
    out = out.select("at", "q.*").withColumn("gold_files", F.coalesce("gold_files", F.when(F.col("gold_file").isNotNull(), F.array("gold_file")), F.array().cast("array<string>")))
    out = out.withColumn("gold_hops", F.transform_keys("gold_hops", lambda k, v: k.cast("long")))
    return out.withColumnRenamed("at", "place").drop("gold_file")
