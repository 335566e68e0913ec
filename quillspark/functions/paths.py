"""Path and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column, windows: bool = False) -> Column:
    return F.element_at(F.split(path, r"[/\\]" if windows else "/"), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a file in the root."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def directory_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def depth(path: Column) -> Column:
    return F.size(directory_parts(path))


def plain_depth(path: Column) -> Column:
    """The depth after double slashes and single dots are dropped."""
    return F.size(F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))) - 1


def named(path: Column, name: str) -> Column:
    """Whether the basename equals name, in any letter case."""
    low = name.lower()
    return (F.lower(path) == low) | F.lower(path).endswith("/" + low)


def named_exactly(path: Column, name: str) -> Column:
    return (path == name) | path.endswith("/" + name)


def has_suffix(path: Column, suffix: str = ".md") -> Column:
    return F.lower(path).endswith(suffix)


def hidden(path: Column, folder: str = ".claude") -> Column:
    """Whether the file lies directly in a settings folder."""
    return F.coalesce(F.lower(F.try_element_at(directory_parts(path), F.lit(-1))) == folder, F.lit(False))


def logical_scope(path: Column, folder: str = ".claude") -> Column:
    """Directory that the file speaks for: D/.claude/X stands for D/X."""
    own = directory_parts(path)
    return F.array_join(F.when(hidden(path, folder), F.slice(own, 1, F.size(own) - 1)).otherwise(own), "/")


def placement_form(path: Column, folder: str = ".claude") -> Column:
    return F.when(hidden(path, folder), "hidden").otherwise("direct")


def location(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "root").otherwise("nested")


def normalized(path: Column) -> Column:
    """. and .. resolved as text; leading .. stay, and a leading slash too; empty becomes "."."""
    rooted = path.startswith("/")
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def resolved(source: Column, target: Column) -> Column:
    """A target beside its source file; a leading slash is the repository's root."""
    base = directory(source)
    return F.when(target.startswith("/"), F.ltrim(normalized(target), F.lit("/"))).otherwise(normalized(F.when(base == "", target).otherwise(F.concat(base, F.lit("/"), target))))


def relation(source: Column, target: Column) -> Column:
    """Where a resolved target lies as seen from the source file's directory."""
    a, b = directory_parts(source), directory_parts(target)
    starts = lambda long, short: F.slice(long, 1, F.size(short)) == short
    return (
        F.when((target == "..") | target.startswith("../"), "outside_repository")
        .when(a == b, "same_directory")
        .when((F.size(b) < F.size(a)) & starts(a, b), "ancestor_directory")
        .when((F.size(b) > F.size(a)) & starts(b, a), "descendant_directory")
        .otherwise("other_directory")
    )


def target_category(name: Column, target: Column) -> Column:
    """What kind of document a target is, by its name and directories."""
    low = F.lower(name)
    stem = F.regexp_replace(low, r"\.md$", "")
    parts = F.transform(directory_parts(target), F.lower)
    within = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(low == "agents.md", "agents_md")
        .when(low == "claude.md", "claude_md")
        .when(low.startswith("readme"), "readme_md")
        .when(low.startswith("contributing"), "contributing_md")
        .when(stem.contains("rule") | within("rules"), "rules_md")
        .when(stem.rlike("instruction|guideline|convention|policy"), "instruction_guidance_md")
        .when(stem.contains("skill") | within("skill", "skills"), "skills_md")
        .when(within("doc", "docs", "documentation"), "project_docs_md")
        .otherwise("other_md")
    )


def import_kind(target: Column) -> Column:
    """What kind of path an import names; the order of the cases matters."""
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "unsupported_uri")
        .when(target.rlike("[*?#{}]"), "unsupported_pattern")
        .when(target.contains("$") | target.startswith("%"), "unsupported_variable")
        .when(target.startswith("~/") | target.startswith("~\\"), "home_relative")
        .when(target.startswith("\\\\"), "windows_unc_absolute")
        .when(target.rlike(r"^[A-Za-z]:[\\/]"), "windows_absolute")
        .when(target.startswith("/"), "posix_absolute")
        .when(target.contains("\\"), "platform_relative")
        .otherwise("relative")
    )


def extension_class(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".md"), "markdown").when(F.ltrim(name, F.lit(".")).contains("."), "other_extension").otherwise("extensionless")


def target_shape(target: Column, extension: Column) -> Column:
    return (
        F.when(extension == "markdown", "markdown_file")
        .when(extension == "other_extension", "other_extension_file")
        .when(target.rlike(r"[/\\]"), "path_extensionless")
        .when(target.startswith("."), "dotfile_extensionless")
        .otherwise("bare_extensionless")
    )


def anomalies(path: Column) -> dict[str, Column]:
    """Flags of odd stored paths, as 0 or 1."""
    flags = {"leading_slash": path.startswith("/"), "double_slash": path.contains("//"), "backslash": path.contains("\\"), "dot_component": F.exists(F.split(path, "/"), lambda x: x.isin(".", ".."))}
    return {k: v.cast("int") for k, v in flags.items()}


#: Directory names that tell what a copy is for.
CONTEXTS = {
    "benchmark_or_run": ["benchmark", "benchmarks", "eval", "evals", "evaluation", "evaluations", "fixture", "fixtures", "run", "runs"],
    "template_or_example": ["example", "examples", "sample", "samples", "scaffold", "scaffolds", "starter", "starters", "template", "templates"],
    "mirror_or_vendor": ["mirror", "mirrors", "third_party", "vendor", "vendored"],
    "skill_plugin_or_agent": ["agent", "agents", "plugin", "plugins", "skill", "skills"],
    "package_app_or_component": ["app", "apps", "component", "components", "connector", "connectors", "crate", "crates", "package", "packages", "service", "services"],
}


def context_tags(components: Column) -> Column:
    """Tags of a set of lower-cased directory names, joined by semicolons."""
    found = [F.when(F.arrays_overlap(components, F.array(*map(F.lit, names))), tag) for tag, names in CONTEXTS.items()]
    return F.concat_ws(";", *found)


def url_is_markdown(url: Column) -> Column:
    """Whether an http, https or file URL has a path that ends in .md; malformed ones don't."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https", "file") & F.lower(F.try_url_decode(F.try_parse_url(url, F.lit("PATH")))).endswith(".md"), F.lit(False))
