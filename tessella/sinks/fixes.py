"""Fixes for issues: which edit a fix id makes, as expressions over the issue's line."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import lang as langs

# fixed values: how each language reads an environment variable (NAME stands for it), and the quotes of its secrets
ENVIRONMENT = {
    "go": 'os.Getenv("NAME")', "typescript": "process.env.NAME", "python": 'os.environ.get("NAME")', "java": 'System.getenv("NAME")', "kotlin": 'System.getenv("NAME")', "ruby": 'ENV["NAME"]', "php": "getenv('NAME')",
    "csharp": 'Environment.GetEnvironmentVariable("NAME")', "swift": 'ProcessInfo.processInfo.environment["NAME"]', "c": 'getenv("NAME")', "cpp": 'std::getenv("NAME")', "rust": 'std::env::var("NAME").unwrap_or_default()', "perl": "$ENV{NAME}",
    "powershell": "$env:NAME", "groovy": "System.getenv('NAME')", "scala": 'sys.env("NAME")', "r": 'Sys.getenv("NAME")', "objc": '[[[NSProcessInfo processInfo] environment] objectForKey:@"NAME"]', "dart": "Platform.environment['NAME']", "bash": '"${NAME}"',
    "elixir": 'System.get_env("NAME")', "lua": 'os.getenv("NAME")', "nim": 'getEnv("NAME")', "crystal": 'ENV["NAME"]', "vlang": "os.getenv('NAME')", "dlang": 'environment.get("NAME")', "clojure": '(System/getenv "NAME")', "erlang": 'os:getenv("NAME")',
    "fsharp": 'Environment.GetEnvironmentVariable("NAME")', "ocaml": '(Sys.getenv "NAME")', "julia": 'ENV["NAME"]', "visualbasic": 'Environment.GetEnvironmentVariable("NAME")', "pascal": "GetEnvironmentVariable('NAME')",
}
# fixed values: fix ids that take the line away
DELETIONS = ("anti-console-log", "anti-debug-print", "anti-sysout", "anti-printstacktrace", "anti-debug-macro", "ruby-debugger", "php-debug-dd", "swift-debug-verbose", "ts-remove-ignore", "csharp-debug-trace")


def env_name(name: Column) -> Column:
    """A variable's name in upper case with underscores between its words."""
    words = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.upper(F.regexp_replace(words, r"[-.]", "_"))


def variable_name(line: Column) -> Column:
    """The name that a line assigns to, '' for none: before := or =, without keyword and type, or the key before a colon."""
    t = F.trim(line)
    short = F.trim(F.regexp_extract(t, r"^(.+?):=", 1))
    plain = F.trim(F.regexp_replace(F.regexp_extract(F.regexp_replace(t, r"^(export\s+)?(var|const|let)\s+", ""), r"^([^=]+?)\s*=", 1), r":.*$", ""))
    key = F.regexp_extract(t, r"[\"']?(\w+)[\"']?\s*:", 1)
    return F.when(t.rlike(r"^.+?:="), short).when(t.rlike("^[^=]+="), plain).otherwise(key)


def without_name(line: Column, name: Column) -> Column:
    """An import line without one of the names that it lists; '' if it is the only one, the line itself if it doesn't list it."""
    listed = F.coalesce(F.nullif(F.regexp_extract(line, r"\{([^}]*)\}", 1), F.lit("")), F.regexp_extract(line, r"\bimport\s+\(?([^()]*?)\)?\s*$", 1))
    names = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(names, lambda x: F.regexp_extract(x, r"^(?:type\s+)?([\w$*]+)", 1) != name)
    braced = F.when(line.contains("{"), F.concat(F.lit("{ "), F.array_join(kept, ", "), F.lit(" }"))).otherwise(F.array_join(kept, ", "))
    inside = F.when(line.contains("{"), F.concat(F.lit("{"), listed, F.lit("}"))).otherwise(listed)
    return F.when(F.size(kept) == F.size(names), line).when(F.size(kept) == 0, F.lit("")).otherwise(F.replace(line, inside, braced))


def fixed_line(fix_id: Column, lang: Column, line: Column, missing: Column | None = None) -> Column:
    """The new text of a line: '' takes it away, null means that there is no fix for it. ``missing``: the name that an
    import lists and its target doesn't export."""
    one_line = line.rlike(r"^\s*(import\b|from\s+\S+\s+import\b|export\b.*\bfrom\b|(const|let|var)\b.*\brequire\(|_?\s*\w*\s*\"[^\"]+\"\s*$)") & ~line.rlike(r"[({]\s*$")
    broken = F.when(lang.isin("go", "typescript", "python", "rust") & (one_line | line.rlike(r"^\s*use\s+.*;\s*$")), F.lit(""))
    name = F.when(variable_name(line) == "", F.lit("SECRET")).otherwise(env_name(variable_name(line)))
    reads = F.try_element_at(F.create_map(*(F.lit(x) for pair in ENVIRONMENT.items() for x in pair)), lang)
    value = F.regexp_extract(line, r"(\"[^\"]{8,}\"|'[^']{8,}')", 1)
    secret = F.when((value != "") & reads.isNotNull(), F.replace(line, value, F.replace(reads, F.lit("NAME"), name)))
    random = F.when(lang == "typescript", F.replace(line, F.lit("Math.random()"), F.lit("crypto.randomUUID()"))).when(lang == "python", F.replace(line, F.lit("random.random()"), F.lit("secrets.token_hex(16)")))
    new = (
        F.when(fix_id.isin(*DELETIONS) | fix_id.rlike(r"-debug-(print|trace)$"), F.lit("")).when(fix_id == "sec-hardcoded-secret", secret).when(fix_id == "sec-insecure-random", random)
        .when(fix_id == "ts-any-to-unknown", F.regexp_replace(line, r":\s*any\b", ": unknown")).when(fix_id == "import-broken", broken)
        .when((fix_id == "import-missing-export") & lang.isin("typescript", "python") & one_line, F.lit(None) if missing is None else F.when(missing.isNotNull(), without_name(line, missing)))
    )
    return F.when(~new.eqNullSafe(line), new)


def edits(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line, old_text, new_text, fix_id) for issues (file, line, fix_id, and name where an import lacks one) whose line and fix are known."""
    if "name" not in issues.columns:
        issues = issues.withColumn("name", F.lit(None).cast("string"))
    at = lines.select("file", "line", F.col("content").alias("old_text"))
    both = issues.where("line > 0 and fix_id <> ''").select("file", "line", "fix_id", "name").distinct().join(at, ["file", "line"])
    return both.withColumn("new_text", fixed_line(F.col("fix_id"), langs.language(F.col("file")), F.col("old_text"), F.col("name"))).where("new_text is not null").select("file", "line", "old_text", "new_text", "fix_id")
