"""One analysis of a diff: scan, merge, suppress, subtract the baseline, check compliance."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessella.functions import lang as langs
from tessella.functions import paths
from tessella.operators import guards
from tessella.operators import issues as I
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.lineage import durable, spread
from tessella.sources import config, tree
from tessella.plans import complexity, guard_packs, hunk_checks, packs, pattern_packs, relational, security_packs

#: Parts of an analysis that run at once; each is a small plan of its own.
AT_ONCE = 4
COLUMNS = ["file_id", "file", "line", "id", "severity", "category", "message"]


@dataclass
class Context:
    """What analyzers see: the diff's files and lines, and the settings of the run."""

    files: DataFrame
    custom: tuple[R.CustomRule, ...] = ()
    enabled: frozenset[str] | None = None
    marker: str = "lint:ignore"
    baseline: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    made: dict = field(default_factory=dict, init=False, repr=False)
    lock: RLock = field(default_factory=RLock, init=False, repr=False)

    @property
    def lines(self) -> DataFrame:
        """The lines of the diff, exploded and written once."""
        return self.once("lines", lambda: L.diff_lines(spread(self.files)))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A relation that several analyzers read, computed and written once."""
        with self.lock:
            if name not in self.made:
                self.made[name] = durable(make())
            return self.made[name]


#: Rule groups and guarded rules by analyzer: all of an analysis run in one scan and in one pass of windows.
GROUPS: dict[str, tuple[R.Group, ...]] = {
    "security": (*packs.SECURITY, *security_packs.LANGUAGES), "migration": packs.MIGRATIONS, "patterns": (packs.CONSOLE, *pattern_packs.ALL),
}
GUARDS: dict[str, tuple[guards.Guarded, ...]] = {"errorhandling": guard_packs.ERRORS, "resource": guard_packs.RESOURCE, "concurrency": guard_packs.CONCURRENCY}
#: What else analyzers look for.
CHECKS: dict[str, tuple[Callable[[Context], DataFrame], ...]] = {
    "patterns": tuple((lambda ctx, f=f: f(ctx.lines)) for f in (hunk_checks.commented_code, hunk_checks.unreachable_code, hunk_checks.shell_without_set_e, hunk_checks.scope_without_failure)),
    "migration": (lambda ctx: hunk_checks.migration_files(ctx.lines),), "complexity": (lambda ctx: complexity.issues(ctx.lines),),
    "custom": (lambda ctx: R.scan_custom(ctx.lines, ctx.custom),),
    **{name: (check,) for name, check in relational.ANALYZERS.items()},
}
CHECKS["hallucination"] = (*CHECKS["hallucination"], lambda ctx: hunk_checks.stubs(ctx.lines))
#: Names of all analyzers. Unknown names in ``enabled`` are ignored.
ANALYZERS: tuple[str, ...] = tuple(dict.fromkeys((*GROUPS, *GUARDS, *CHECKS)))


def configured(files: DataFrame, settings: dict, **more) -> Context:
    """The context of one run's settings (config.load): which analyzers and languages are on, what is ignored, own rules.

    Files of a known language that isn't listed are left out; those of no known language stay, for some rules read them.
    """
    place = paths.unix(F.col("path"))
    listed = settings.get("languages") or list(langs.LANGUAGES)
    lang = langs.language(place)
    kept = files.where(~tree.ignored(place, settings.get("ignore") or [])).where(lang.isNull() | lang.isin(*listed))
    return Context(kept, custom=config.custom_rules(settings), enabled=config.enabled(settings), **more)


def _failed(ctx: Context, name: str, error: Exception) -> DataFrame:
    """The one issue that tells of an analyzer that can't run."""
    text = str(error).split("\n")[0][:200]
    row = [(None, "", 0, f"internal-{name}-error", "info", "internal", f'Analyzer "{name}" failed: {text}')]
    return ctx.files.sparkSession.createDataFrame(row, "file_id long, file string, line int, id string, severity string, category string, message string")


def _checked(ctx: Context, name: str, check: Callable[[Context], DataFrame]) -> DataFrame:
    """A check's issues; one whose plan can't be made costs its own issues only. Failures of the cluster aren't caught."""
    try:
        return check(ctx).select(*COLUMNS)
    except (AnalysisException, ValueError, KeyError) as error:
        return _failed(ctx, name, error)


def found_by(ctx: Context, names: Iterable[str]) -> DataFrame | None:
    """The issues of the named analyzers: one scan of the lines for all rules, one pass for all guarded rules, and the checks.

    The lines are exploded and written once, and so are the issues of each part: one plan of all would need more memory
    than a driver has.
    """
    names = [n for n in names if n in ANALYZERS]
    groups, guarded = [g for n in names for g in GROUPS.get(n, ())], [g for n in names for g in GUARDS.get(n, ())]
    parts = [R.scan(ctx.lines, groups)] if groups else []
    if guarded:
        parts.append(guards.guarded_issues(ctx.lines, guarded))
    works = [*((lambda p=p: p) for p in parts), *((lambda n=n, c=c: _checked(ctx, n, c)) for n in names for c in CHECKS.get(n, ()))]
    ctx.lines  # written before the parts read it
    with ThreadPoolExecutor(AT_ONCE) as pool:  # the parts are independent: small ones fill the cores that others leave idle
        written = list(pool.map(lambda work: durable(work().select(*COLUMNS)), works))
    found: DataFrame | None = None
    for part in written:
        found = part if found is None else found.unionByName(part)
    return found


def analyse(ctx: Context, analyzers: Iterable[str] | None = None) -> DataFrame:
    """The issues of all enabled analyzers, after suppression and baseline, unordered (see issues.ordered)."""
    names = [n for n in (analyzers or ANALYZERS) if ctx.enabled is None or n in ctx.enabled]
    found = found_by(ctx, names)
    if found is None:
        return ctx.lines.limit(0).select("file_id", "file", F.col("new_num").alias("line"), *(F.lit("").alias(c) for c in COLUMNS[3:]))
    marks = I.directives(ctx.lines.select("file", F.col("new_num").alias("line"), "content"), ctx.marker)
    kept = I.unsuppressed(found, marks)
    return I.not_in_baseline(kept, ctx.baseline) if ctx.baseline is not None else kept


def result(ctx: Context, issues: DataFrame) -> DataFrame:
    """One row: counts, summary and whether the run blocks."""
    files = ctx.files.agg(F.count_distinct("file_id").alias("files")).scalar()
    n = I.counts(issues).withColumn("files", files)
    return n.withColumn("summary", I.summary_text(*(F.col(c) for c in ("errors", "warnings", "infos", "total", "files"))))
